"""Column roles and fixed settings shared by every operator.

An :class:`AuditSpec` names the columns of a decision table; operators take
it instead of positional arrays, so every metric is a plain aggregate over
named columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values (must equal the audited pipeline's settings) -------------
DISPARATE_IMPACT_THRESHOLD = 0.8      # four-fifths rule, pass band [0.8, 1/0.8]
STATISTICAL_PARITY_THRESHOLD = 0.1    # |SPD| <= 0.1
EQUAL_OPPORTUNITY_THRESHOLD = 0.1     # |EOD| <= 0.1
FAIRNESS_WEIGHT = 0.3                 # composite = 0.7 * performance + 0.3 * fairness
RANDOM_SEED = 42
TEST_SIZE = 0.2
CV_FOLDS = 3
N_TRIALS = 50
DEFAULT_CUT = 0.5                     # predicted label = p >= cut
THRESHOLD_BOUNDS = (0.1, 0.9)         # search range for group thresholds
RISK_TIER_CUTS = (0.3, 0.6)           # Low < 0.3 <= Medium < 0.6 <= High
POSITIVE_CLASS_MULTIPLIER = 2.33      # boosting positive-class weight (70/30 imbalance)
MODEL_FAMILIES = ("random_forest", "gbt", "gbt_leafwise", "logistic_regression")
AGE_BIN_EDGES = (18, 25, 35, 45, 55, 100)
AGE_BIN_LABELS = ("18-25", "26-35", "36-45", "46-55", "55+")
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class AuditSpec:
    """Roles of the columns of a decision table.

    ``label``: observed outcome, ``favorable`` is the good value (0 = no default).
    ``group``: protected attribute column, ``privileged`` its privileged value.
    ``score``: probability of the unfavourable class (class 1), optional.
    ``pred``: predicted label column, optional.
    ``weight``: instance weight column, optional.
    """

    id: str = "id"
    label: str = "y"
    group: str = "g"
    score: str | None = "p"
    pred: str | None = "pred"
    weight: str | None = None
    favorable: int = 0
    privileged: int | str = 1
    attributes: tuple[str, ...] = field(default_factory=tuple)

    def with_(self, **kw) -> "AuditSpec":
        d = {k: getattr(self, k) for k in self.__dataclass_fields__}
        d.update(kw)
        return AuditSpec(**d)


# Roles of the decision frame built from the test tables (sources.frames).
DECISIONS = AuditSpec(attributes=("segment", "region", "priority", "price_band"))
