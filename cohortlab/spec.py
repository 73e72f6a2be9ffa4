"""Declarative description of a cohort table.

Every operator takes its column names from a :class:`CohortSpec`, so the
library never hard-codes a schema.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class CohortSpec:
    """Roles of the columns of a cohort with a binary target."""

    id_col: str
    target: str
    features: tuple[str, ...]
    categorical: tuple[str, ...] = ()
    drop: tuple[str, ...] = ()
    leakage: tuple[str, ...] = ()
    groups: dict[str, tuple[str, ...]] = field(default_factory=dict)
    shifts: dict[str, float] = field(default_factory=dict)
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)
    labels: dict[int, str] = field(default_factory=lambda: {0: "Negative (0)", 1: "Positive (1)"})

    def present(self, df: DataFrame, columns) -> list[str]:
        """The given columns that exist in ``df``, in the given order."""
        have = set(df.columns)
        return [c for c in columns if c in have]

    def numeric_columns(self, df: DataFrame) -> list[str]:
        """Columns of ``df`` with a numeric type, in schema order."""
        return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]

    def leakage_report(self, df: DataFrame) -> dict:
        """Leakage columns found in ``df`` and the feature count left without them."""
        found = self.present(df, self.leakage)
        kept = [c for c in self.present(df, self.features) if c not in found]
        return {"removed": found, "n_removed": len(found), "n_remaining": len(kept)}

    def without_leakage(self) -> CohortSpec:
        """The same cohort with the leakage columns taken out of the features."""
        kept = tuple(c for c in self.features if c not in self.leakage)
        return replace(self, features=kept)


# --- Fixed values: the patient table -----------------------------------------
# Column names, roles, feature groups, what-if shifts and entry bounds of the
# patient table this library is used with.

PATIENT_SCHEMA = T.StructType(
    [
        T.StructField("PatientID", T.StringType()),
        T.StructField("Age", T.IntegerType()),
        T.StructField("Gender", T.IntegerType()),
        T.StructField("BMI", T.DoubleType()),
        T.StructField("Smoking", T.IntegerType()),
        T.StructField("PhysicalActivity", T.DoubleType()),
        T.StructField("DietQuality", T.DoubleType()),
        T.StructField("SleepQuality", T.DoubleType()),
        T.StructField("FamilyHistoryKidneyDisease", T.IntegerType()),
        T.StructField("FamilyHistoryHypertension", T.IntegerType()),
        T.StructField("FamilyHistoryDiabetes", T.IntegerType()),
        T.StructField("SystolicBP", T.DoubleType()),
        T.StructField("DiastolicBP", T.DoubleType()),
        T.StructField("FastingBloodSugar", T.DoubleType()),
        T.StructField("HbA1c", T.DoubleType()),
        T.StructField("SerumCreatinine", T.DoubleType()),
        T.StructField("BUNLevels", T.DoubleType()),
        T.StructField("GFR", T.DoubleType()),
        T.StructField("ProteinInUrine", T.DoubleType()),
        T.StructField("ACR", T.DoubleType()),
        T.StructField("SerumElectrolytesSodium", T.DoubleType()),
        T.StructField("SerumElectrolytesPotassium", T.DoubleType()),
        T.StructField("HemoglobinLevels", T.DoubleType()),
        T.StructField("CholesterolTotal", T.DoubleType()),
        T.StructField("Edema", T.IntegerType()),
        T.StructField("FatigueLevels", T.DoubleType()),
        T.StructField("QualityOfLifeScore", T.DoubleType()),
        T.StructField("HeavyMetalsExposure", T.IntegerType()),
        T.StructField("Adherence", T.StringType()),
        T.StructField("RecommendedVisitsPerMonth", T.DoubleType()),
        T.StructField("Diagnosis", T.IntegerType()),
    ]
)

PATIENT_GROUPS = {
    "Lifestyle": ("BMI", "PhysicalActivity", "DietQuality", "SleepQuality", "Smoking"),
    "Clinical": ("SystolicBP", "DiastolicBP", "FastingBloodSugar", "HbA1c", "HemoglobinLevels"),
    "Biochemical": ("SerumElectrolytesSodium", "SerumElectrolytesPotassium", "CholesterolTotal"),
    "Demographics": ("Age", "Gender"),
    "Family History": (
        "FamilyHistoryKidneyDisease",
        "FamilyHistoryHypertension",
        "FamilyHistoryDiabetes",
    ),
    "Other": ("Adherence", "Edema", "FatigueLevels", "QualityOfLifeScore", "HeavyMetalsExposure"),
}

PATIENT_SHIFTS = {
    "SystolicBP": -20.0,
    "DiastolicBP": -10.0,
    "FastingBloodSugar": -20.0,
    "HbA1c": -1.0,
    "BMI": -3.0,
    "PhysicalActivity": 50.0,
    "DietQuality": 3.0,
    "SleepQuality": 2.0,
    "CholesterolTotal": -30.0,
    "FatigueLevels": -3.0,
}

PATIENT_BOUNDS = {
    "Age": (20.0, 90.0),
    "BMI": (15.0, 45.0),
    "PhysicalActivity": (0.0, 300.0),
    "DietQuality": (0.0, 10.0),
    "SleepQuality": (0.0, 10.0),
    "SystolicBP": (90.0, 200.0),
    "DiastolicBP": (60.0, 130.0),
    "FastingBloodSugar": (70.0, 250.0),
    "HbA1c": (4.0, 15.0),
    "HemoglobinLevels": (10.0, 20.0),
    "CholesterolTotal": (100.0, 400.0),
    "SerumElectrolytesSodium": (130.0, 150.0),
    "SerumElectrolytesPotassium": (3.0, 6.0),
    "FatigueLevels": (0.0, 10.0),
    "QualityOfLifeScore": (0.0, 100.0),
}

PATIENT_LEAKAGE = ("GFR", "SerumCreatinine", "BUNLevels", "ProteinInUrine", "ACR")

PATIENTS = CohortSpec(
    id_col="PatientID",
    target="Diagnosis",
    features=tuple(
        f.name
        for f in PATIENT_SCHEMA.fields
        if f.name not in ("PatientID", "RecommendedVisitsPerMonth", "Diagnosis")
    ),
    categorical=("Adherence",),
    drop=("RecommendedVisitsPerMonth",),
    leakage=PATIENT_LEAKAGE,
    groups=PATIENT_GROUPS,
    shifts=PATIENT_SHIFTS,
    bounds=PATIENT_BOUNDS,
)
