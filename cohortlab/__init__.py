"""cohortlab: risk-classification analytics on tabular cohorts, as Spark jobs.

The package is organised by what a job does with a cohort table:

``sources``    readers, stand-in cohorts, sinks and the run cache
``functions``  column expressions and distributed building blocks
``operators``  audit, sampling, preparation, balancing, metrics, curves,
               neighbours, models, explanation and subject services
``plans``      whole experiments and the registered queries
``streaming``  scoring of a stream of subjects
"""

from cohortlab.spec import CohortSpec

__all__ = ["CohortSpec"]
