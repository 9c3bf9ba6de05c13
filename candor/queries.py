"""Every query of the library by name, with the DuckDB SQL that gives the same rows."""

from candor.plans import evaluation, frames, learning, media, pipelines, reports  # noqa: F401
from candor.plans.registry import ORACLES, QUERIES  # noqa: F401
