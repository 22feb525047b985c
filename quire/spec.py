"""Survey specifications: every name, group and mapping the operators use.

Operators take a ``SurveySpec`` instead of hard-coding column names, so a
new questionnaire version is a new spec, not new code.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Question:
    column: str          # wide column name, e.g. "fht1"
    group: str           # answer group expected for the question
    number: int          # questionNumber in the stored answer array


@dataclass(frozen=True)
class SurveySpec:
    name: str
    questions: tuple[Question, ...]
    # recode: column -> {raw value: recoded value}; a row holding any other
    # value (NULL included) in a recoded column is dropped.
    recode: dict
    # derived groups: name -> member columns
    groups: dict
    # ratio name -> (numerator group, denominator group), on group sums
    ratios: tuple
    # interaction name -> (group a, group b), product of group averages
    interactions: tuple
    min_items: int = 18
    target: str = "ust"
    key: str = "user_id"
    payload_groups: tuple = ()          # groups a scoring payload must carry
    categorical: tuple = ()             # categorical columns (P17/P18, F7)
    rollup_prefixes: tuple = ("category_", "type_", "region_")
    choice_domain: tuple = (1, 2, 3)

    @property
    def columns(self) -> list[str]:
        return [q.column for q in self.questions]

    @property
    def stems(self) -> list[str]:
        """Answer groups in spec order (e.g. ['fht', 'kmsi'])."""
        out: list[str] = []
        for q in self.questions:
            if q.group not in out:
                out.append(q.group)
        return out

    def group_features(self) -> list[str]:
        out = []
        for g in self.groups:
            out += [f"{g}_score_sum", f"{g}_score_avg", f"{g}_score_var", f"{g}_high_score_count"]
        return out

    def engineered_columns(self) -> list[str]:
        return (self.columns + self.group_features() + [r[0] for r in self.ratios]
                + [i[0] for i in self.interactions])

    def model_columns(self, drop_suffixes=("_sum", "_count", "_var")) -> list[str]:
        return [c for c in self.engineered_columns() if not c.endswith(tuple(drop_suffixes))]


# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results: question
# numbering, answer groups, recode maps, derived groups, ratios and
# interactions of the two-group questionnaire ("fsk_v2.0" training slug,
# "rdf50_v3.0_fk_v1.0" scoring label).
# ---------------------------------------------------------------------------
FHT_COLUMNS = ["fht1", "fht2", "fht3", "fht4", "fht5", "fht6", "fht7", "fht8"]
KMSI_COLUMNS = ["kmsi1", "kmsi2", "kmsi3", "kmsi4", "kmsi5", "kmsi6", "kmsi7", "kmsi8"]
SET_COLUMNS = ["set1", "set2"]
# questionNumber of each column: fht1-8 -> 1-8, set1-2 -> 9-10, kmsi1-8 -> 11-18
QUESTION_NUMBERS = {
    "fht1": 1, "fht2": 2, "fht3": 3, "fht4": 4, "fht5": 5, "fht6": 6, "fht7": 7, "fht8": 8,
    "set1": 9, "set2": 10,
    "kmsi1": 11, "kmsi2": 12, "kmsi3": 13, "kmsi4": 14,
    "kmsi5": 15, "kmsi6": 16, "kmsi7": 17, "kmsi8": 18,
}
REVERSED = {1: 3, 2: 2, 3: 1}
IDENTITY = {1: 1, 2: 2, 3: 3}
RECODE = {
    **{c: REVERSED for c in FHT_COLUMNS},
    "kmsi1": IDENTITY, "kmsi2": IDENTITY, "kmsi3": IDENTITY,
    "kmsi4": IDENTITY, "kmsi5": IDENTITY, "kmsi6": IDENTITY,
    "kmsi7": REVERSED, "kmsi8": REVERSED,
}
GROUPS = {
    "spending": ["fht1", "fht2"],
    "saving": ["fht3", "fht4"],
    "payoff": ["fht5", "fht6"],
    "planning": ["fht7", "fht8"],
    "loan": ["kmsi1", "kmsi2"],
    "worship": ["kmsi3", "kmsi4"],
    "extravagance": ["kmsi5", "kmsi6"],
    "vigilance": ["kmsi7", "kmsi8"],
}
RATIOS = (
    ("loan_to_saving_ratio", "loan", "saving"),
    ("worship_to_vigilance_ratio", "worship", "vigilance"),
    ("extravagance_to_spending_ratio", "extravagance", "spending"),
    ("worship_to_payoff_ratio", "worship", "payoff"),
)
INTERACTIONS = (
    ("loan_extravagance_interaction", "loan", "extravagance"),
    ("payoff_planning_interaction", "payoff", "planning"),
    ("spending_vigilance_interaction", "spending", "vigilance"),
    ("worship_extravagance_interaction", "worship", "extravagance"),
)
TRAINING_SLUG = "fsk_v2.0"
SCORING_LABEL = "rdf50_v3.0_fk_v1.0"
# Screening constants: population mean 2, variance 2/3, two-sided 5 % z cut.
SCREEN_MEAN = 2.0
SCREEN_VARIANCE = 2.0 / 3.0
SCREEN_Z = 1.96
# Scoring decision cut on p(class 1) for the adjusted prediction.
ADJUSTED_THRESHOLD = 0.75
# Suffixes pruned before modelling (training) and before scoring.
TRAIN_DROP_SUFFIXES = ("_sum", "_count", "_var")
SCORE_DROP_SUFFIXES = ("_sum",)
# ---------------------------------------------------------------------------


def _questions(columns):
    return tuple(Question(c, c.rstrip("0123456789"), QUESTION_NUMBERS[c]) for c in columns)


FK_V1 = SurveySpec(
    name="fk_v1.0",
    questions=_questions(FHT_COLUMNS + KMSI_COLUMNS),
    recode=RECODE,
    groups=GROUPS,
    ratios=RATIOS,
    interactions=INTERACTIONS,
    payload_groups=("fht", "kmsi"),
)

# Three-group variant: 'set' answers are carried but neither recoded nor
# grouped (the reference leaves them out of both maps).
FSK_V2 = SurveySpec(
    name="fsk_v2.0",
    questions=_questions(FHT_COLUMNS + SET_COLUMNS + KMSI_COLUMNS),
    recode=RECODE,
    groups=GROUPS,
    ratios=RATIOS,
    interactions=INTERACTIONS,
    payload_groups=("fht", "set", "kmsi"),
)

# Application label -> spec used to score it (C8 routing table).
SPEC_REGISTRY = {SCORING_LABEL: FK_V1}
