"""Whole pipelines over CSV files: patients and their histories, defendants, incomes."""

from tracewell.pipelines.incomes import incomes, incomes_with_imputation
from tracewell.pipelines.recidivism import recidivism
from tracewell.pipelines.risks import risks

__all__ = ["incomes", "incomes_with_imputation", "recidivism", "risks"]
