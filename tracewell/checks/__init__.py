"""Checks over the recorded graph and what the inspections found."""

from tracewell.checks.base import Check, CheckResult, CheckStatus
from tracewell.checks.bias import NoBiasIntroducedFor, distribution_change
from tracewell.checks.features import NoIllegalFeatures, NoMissingEmbeddings

__all__ = ["Check", "CheckResult", "CheckStatus", "NoBiasIntroducedFor", "NoIllegalFeatures", "NoMissingEmbeddings", "distribution_change"]
