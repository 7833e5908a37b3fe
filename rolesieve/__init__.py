"""Job-posting enrichment, filtering and deduplication as Spark DataFrame operators."""

from rolesieve.options import RunOptions
from rolesieve.plans.run import execute_run, run_pipeline
from rolesieve.streaming.incremental import incremental_run

__all__ = ["RunOptions", "execute_run", "incremental_run", "run_pipeline"]
