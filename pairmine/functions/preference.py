"""Preference-loss expressions over log-probability columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairmine.settings import DEFAULTS

# The known losses.
LOSSES = ("sigmoid", "hinge")


def sequence_logp(token_logps: Column, mask: Column) -> Column:
    """Sum of the token log-probabilities where the completion mask is 1."""
    kept = F.zip_with(token_logps, mask, lambda logp, bit: F.when(bit != 0, logp).otherwise(0.0))
    return F.aggregate(kept, F.lit(0.0), lambda total, x: total + x.cast("double"))


def dpo_logits(
    policy_chosen: Column, policy_rejected: Column, ref_chosen: Column, ref_rejected: Column
) -> Column:
    """How much more the policy prefers the chosen answer than the reference model does."""
    return (policy_chosen - policy_rejected) - (ref_chosen - ref_rejected)


def dpo_loss(logits: Column, loss: str = "sigmoid", beta: float = DEFAULTS.beta) -> Column:
    """Loss of one pair, NULL without logits; the batch loss is the mean of it."""
    scaled = logits * F.lit(float(beta))
    if loss == "sigmoid":
        # -log(sigmoid(x)) in the form that neither overflows nor loses the tail
        return F.greatest(-scaled, F.lit(0.0)) + F.log1p(F.exp(-F.abs(scaled)))
    if loss == "hinge":
        return F.when(logits.isNotNull(), F.greatest(F.lit(1.0) - scaled, F.lit(0.0)))
    raise ValueError(f"unknown loss {loss!r}; expected one of {LOSSES}")


def reward(policy: Column, ref: Column, beta: float = DEFAULTS.beta) -> Column:
    return F.lit(float(beta)) * (policy - ref)
