"""shroud — sensitive-data detection, masking and reversible tokenisation on Spark.

Public surface::

    from shroud import Policy, find, mask, report, lock, unlock, Vault

    masked = mask(df, "text", Policy())           # + findings, masked_text
    rep = report(masked)                          # + n_findings, changed, counts, summary

Every function takes and returns DataFrames; detection, resolution and
masking are narrow (per-row) Catalyst expressions, so they run unchanged in
batch and Structured Streaming plans.
"""

from .operators.contextual import custom_detector
from .operators.detect import find
from .operators.mask import mask
from .operators.report import changed_rows, counts_by, explode_findings
from .operators.report import with_report as report
from .operators.vault import Vault, VaultError, lock, unlock
from .policy import Policy

__all__ = ["Policy", "find", "mask", "report", "changed_rows", "counts_by", "explode_findings", "lock", "unlock", "Vault",
           "VaultError", "custom_detector"]
