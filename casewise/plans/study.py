"""What a study looks for: drug terms, roles, outcome terms, strata. The operators take it as a parameter."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class StudySpec:
    target_terms: tuple[str, ...]
    comparator_terms: tuple[str, ...]
    feature_terms: dict[str, tuple[str, ...]]
    narrow_terms: tuple[str, ...]
    broad_terms: tuple[str, ...]
    target_name: str = "target"
    #: roles, ages and polypharmacy (fixed values)
    suspect_roles: tuple[str, ...] = ("PS", "SS")
    primary_roles: tuple[str, ...] = ("PS",)
    min_age: float = 65.0
    max_age: float = 120.0
    polypharmacy_from: int = 5
    #: outcome codes (fixed values)
    outcome_codes: dict[str, str] = field(
        default_factory=lambda: {
            "DE": "is_death",
            "LT": "is_life_threatening",
            "HO": "is_hospitalization",
            "RI": "is_required_intervention",
            "DS": "is_disability",
            "CA": "is_congenital_anomaly",
            "OT": "is_other_serious",
        }
    )
    comedication: tuple[str, ...] = ("is_benzo", "is_antidepressant", "is_antipsychotic", "is_opioid", "is_antiepileptic")

    @property
    def strata(self) -> list[tuple[str, object]]:
        """Levels that are analysed by themselves (fixed values)."""
        return [
            ("age_group", "65-74"), ("age_group", "75-84"), ("age_group", ">=85"),
            ("sex_clean", "F"), ("sex_clean", "M"), ("serious", True), ("polypharmacy_5", True),
        ]

    @property
    def features(self) -> list[tuple[str, object, str]]:
        """Features with their domains (fixed values)."""
        domains = {"age_group": "demographic", "sex_clean": "demographic", "serious": "severity", "polypharmacy_5": "medication_burden"}
        return [(c, v, domains[c]) for c, v in self.strata] + [(c, True, "co_medication") for c in self.comedication]


_ZOLPIDEM = ("ZOLPIDEM", "AMBIEN", "STILNOX", "EDLUAR", "INTERMEZZO", "ZOLPIMIST")

#: Hypnotic Z-drugs and falls (fixed values: drug names and preferred terms).
Z_DRUGS_AND_FALLS = StudySpec(
    target_name="zolpidem",
    target_terms=_ZOLPIDEM,
    comparator_terms=("ZALEPLON", "SONATA", "ZOPICLONE", "IMOVANE", "ZIMOVANE", "ESZOPICLONE", "LUNESTA"),
    feature_terms={
        "is_zolpidem": _ZOLPIDEM,
        "is_zaleplon": ("ZALEPLON", "SONATA"),
        "is_zopiclone": ("ZOPICLONE", "IMOVANE", "ZIMOVANE"),
        "is_eszopiclone": ("ESZOPICLONE", "LUNESTA"),
        "is_benzo": ("ALPRAZOLAM", "DIAZEPAM", "LORAZEPAM", "CLONAZEPAM", "TEMAZEPAM"),
        "is_antidepressant": (
            "SERTRALINE", "ESCITALOPRAM", "FLUOXETINE", "CITALOPRAM", "PAROXETINE", "VENLAFAXINE", "DULOXETINE", "AMITRIPTYLINE", "MIRTAZAPINE",
        ),
        "is_antipsychotic": ("QUETIAPINE", "OLANZAPINE", "RISPERIDONE", "ARIPIPRAZOLE", "HALOPERIDOL"),
        "is_opioid": ("OXYCODONE", "HYDROCODONE", "MORPHINE", "FENTANYL", "TRAMADOL", "CODEINE"),
        "is_antiepileptic": ("GABAPENTIN", "PREGABALIN", "VALPROATE", "CARBAMAZEPINE", "LAMOTRIGINE"),
    },
    narrow_terms=("FALL", "FALLING", "FALLING DOWN"),
    broad_terms=(
        "FALL", "FALLING", "FALLING DOWN",
        "DISEQUILIBRIUM", "DISEQUILIBRIUM SYNDROME", "GAIT ABNORMAL", "GAIT ABNORMAL NOS", "GAIT DISORDER", "GAIT DISTURBANCE",
        "GAIT INABILITY", "GAIT INSTABILITY", "BALANCE DISORDER",
        "VERTIGO", "VERTIGO (EXCL. DIZZINESS)", "VERTIGO AGGRAVATED", "VERTIGO CNS ORIGIN", "VERTIGO LABYRINTHINE", "VERTIGO POSITIONAL",
        "VESTIBULAR ABNORMALITIES", "VESTIBULAR DISORDER", "VESTIBULAR VERTIGO",
        "VISUAL ACUITY DECREASED", "VISUAL ACUITY LOST", "VISUAL ACUITY REDUCED", "VISUAL DISTURBANCE", "VISUAL DISTURBANCE NOS",
        "VISUAL DISTURBANCES", "VISUAL IMPAIRMENT",
        "HYPOTENSION", "HYPOTENSION AGGRAVATED", "HYPOTENSION ORTHOSTATIC", "HYPOTENSION ORTHOSTATIC ASYMPTOMATIC",
        "HYPOTENSION ORTHOSTATIC SYMPTOMATIC", "HYPOTENSION POSTURAL", "HYPOTENSION POSTURAL AGGRAVATED", "ORTHOSTATIC HYPOTENSION",
        "POSTURAL HYPOTENSION",
    ),
)

#: The same study shape on the generated order tables.
ORDER_TABLES = StudySpec(
    target_name="widget",
    target_terms=("WIDGET",),
    comparator_terms=("GIZMO", "GEAR"),
    feature_terms={
        "is_zolpidem": ("WIDGET",),
        "is_zaleplon": ("GIZMO",),
        "is_zopiclone": ("GEAR",),
        "is_eszopiclone": ("ANVIL",),
        "is_benzo": ("COLD",),
        "is_antidepressant": ("SMALL",),
        "is_antipsychotic": ("LARGE",),
        "is_opioid": ("RED",),
        "is_antiepileptic": ("BLUE",),
    },
    narrow_terms=("PROMO",),
    broad_terms=("PROMO", "LARGE"),
)
