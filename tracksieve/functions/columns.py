"""Scalar column expressions: parsing, grouping bands, identifiers, covariates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that mean "missing".
MISSING_TEXT = ("", "na", "n/a", "nan", "none", "null")

# Canonical orders of the stratification levels.
SEX_ORDER = ("male", "female")
AGE_ORDER = ("18_to_lt_40", "40_to_lt_60", "60_to_lt_75", "ge_75")
COUNT_BAND_ORDER = ("one_case", "two_cases", "three_or_more_cases")

NUL = "\u0000"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- numbers and text -------------------------------------------------------

def is_finite(c: Column | str) -> Column:
    """True for a real number; false for null, NaN and the infinities."""
    c = as_col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def finite(c: Column | str) -> Column:
    """The value where finite, else null."""
    c = as_col(c)
    return F.when(is_finite(c), c)


def r6(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison across engines; never negative zero."""
    return F.round(as_col(c), digits) + F.lit(0.0)


def clean_text(c: Column | str) -> Column:
    """Trimmed text, null for any missing spelling."""
    t = F.trim(as_col(c))
    return F.when(~F.lower(t).isin(*MISSING_TEXT), t)


def try_double(c: Column | str) -> Column:
    return F.trim(as_col(c)).try_cast("double")


def clean_number(c: Column | str) -> Column:
    """Finite number of a text cell, else null (see ``number_class`` for the reason)."""
    return finite(clean_text(c).try_cast("double"))


def number_class(c: Column | str) -> Column:
    """missing / invalid (not numeric or not finite) / value."""
    t = clean_text(c)
    return (
        F.when(t.isNull(), "missing")
        .when(~F.coalesce(is_finite(t.try_cast("double")), F.lit(False)), "invalid")
        .otherwise("value")
    )


def first_present(columns: Sequence[str], aliases: Sequence[str]) -> Column:
    """The first alias that exists as a column; a null text if none does."""
    for name in aliases:
        if name in columns:
            return F.col(name)
    return F.lit(None).cast("string")


def normalize_key(c: Column | str) -> Column:
    """Integer key of trimmed text; null marks an invalid key."""
    t = F.trim(as_col(c).cast("string"))
    return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("bigint"))


def strict_bool(c: Column | str) -> Column:
    """'true'/'false' text to boolean; anything else is an error."""
    c = as_col(c)
    t = F.lower(F.trim(c.cast("string")))
    return (
        F.when(t == "true", True)
        .when(t == "false", False)
        .otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(t, F.lit("<null>")))).cast("boolean"))
    )


def valid_interval(start: Column | str, end: Column | str) -> Column:
    return F.coalesce(as_col(end) > as_col(start), F.lit(False))


# --- bands ------------------------------------------------------------------

def sex_group(c: Column | str) -> Column:
    t = F.upper(F.trim(as_col(c)))
    return F.when(t == "M", "male").when(t == "F", "female").otherwise("missing_or_other")


def age_group(c: Column | str) -> Column:
    a = as_col(c)
    return (
        F.when(~is_finite(a) | (a < 18), "missing_or_invalid")
        .when(a < 40, AGE_ORDER[0]).when(a < 60, AGE_ORDER[1]).when(a < 75, AGE_ORDER[2])
        .otherwise(AGE_ORDER[3])
    )


def bmi(height_cm: Column | str, weight_kg: Column | str) -> Column:
    h, w = as_col(height_cm), as_col(weight_kg)
    return F.when(is_finite(h) & is_finite(w) & (h > 0) & (w > 0), w / ((h / 100.0) * (h / 100.0)))


def bmi_group(c: Column | str) -> Column:
    b = as_col(c)
    return (
        F.when(~is_finite(b) | (b <= 0), "missing_or_invalid")
        .when(b < 18.5, "lt_18_5").when(b < 25, "18_5_to_lt_25").when(b < 30, "25_to_lt_30")
        .otherwise("ge_30")
    )


def asa_group(c: Column | str) -> Column:
    n = finite(as_col(c).try_cast("double"))
    return (
        F.when(n == 1, "ASA_1").when(n == 2, "ASA_2").when(n == 3, "ASA_3")
        .when(n >= 4, "ASA_4_or_higher").otherwise("missing_or_other")
    )


def emergency_group(c: Column | str) -> Column:
    t = F.lower(F.trim(as_col(c)))
    return (
        F.when(t.isin("0", "false", "n", "no"), "non_emergency")
        .when(t.isin("1", "true", "y", "yes"), "emergency")
        .otherwise("missing_or_other")
    )


def text_group(c: Column | str, missing: str = "missing_or_other") -> Column:
    return F.coalesce(F.nullif(F.trim(as_col(c)), F.lit("")), F.lit(missing))


def case_count_band(c: Column | str) -> Column:
    n = as_col(c)
    return F.when(n == 1, COUNT_BAND_ORDER[0]).when(n == 2, COUNT_BAND_ORDER[1]).when(n >= 3, COUNT_BAND_ORDER[2])


def adult_label(c: Column | str) -> Column:
    b = as_col(c)
    return F.when(b, "adult_age_ge_18").when(~b, "not_adult_age_lt_18").otherwise("unknown")


def missing_label(c: Column | str, label: str = "<missing>") -> Column:
    return F.coalesce(F.nullif(as_col(c).cast("string"), F.lit("")), F.lit(label))


def presence_key(flags: Mapping[str, Column]) -> Column:
    """'a=true|b=false' in the given order."""
    return F.concat_ws("|", *[
        F.concat(F.lit(f"{name}="), F.coalesce(flag, F.lit(False)).cast("string"))
        for name, flag in flags.items()
    ])


# --- identifiers ------------------------------------------------------------

def candidate_id(rule: Column, signal_cap: Column, rate_cap: Column) -> Column:
    return F.concat(rule, F.lit("__sig"), signal_cap.cast("string"), F.lit("s__rate"), rate_cap.cast("string"), F.lit("s"))


def parse_candidate_id(c: Column | str) -> Column:
    pattern = r"^(.*)__sig(\d+)s__rate(\d+)s$"
    c = as_col(c)
    return F.struct(
        F.regexp_extract(c, pattern, 1).alias("rule"),
        F.regexp_extract(c, pattern, 2).try_cast("bigint").alias("signal_cap"),
        F.regexp_extract(c, pattern, 3).try_cast("bigint").alias("rate_cap"),
    )


def nul_hash(*parts: Column | str) -> Column:
    """sha256 of the parts joined by a NUL byte: pseudonymous ids and allocation ranks."""
    return F.sha2(F.concat_ws(NUL, *[as_col(p).cast("string") for p in parts]), 256)


def hash_draw(*parts: Column | str) -> Column:
    """A portable uniform draw in [0, 2^60) from hashed parts."""
    h = F.sha2(F.concat_ws("|", *[as_col(p).cast("string") for p in parts]), 256)
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint")


# --- rates, covariate models, response ---------------------------------------

# Published Schnider coefficients h1..h17.
SCHNIDER = dict(
    h1=4.27, h2=18.9, h3=0.391, h4=53.0, h5=238.0, h6=1.89, h7=0.0456, h8=77.0, h9=0.0681,
    h10=59.0, h11=0.0264, h12=177.0, h13=1.29, h14=0.024, h15=53.0, h16=0.836, h17=0.456,
)
# Published Minto coefficients f1..f18; f12 has two named variants.
MINTO = dict(
    f1=5.1, f2=0.0201, f3=0.072, f4=9.82, f5=0.0811, f6=0.108, f7=5.42, f8=2.6, f9=0.0162,
    f10=0.0191, f11=2.05, f13=0.076, f14=0.00113, f15=0.595, f16=0.007, f17=40.0, f18=55.0,
)
MINTO_F12 = {"primary_minto_0.0301": 0.0301, "sensitivity_yun_0.030": 0.030}
# Response surface.
RESPONSE = dict(baseline=98.0, ce50_a=4.47, ce50_b=19.3, hill=1.43)


def ml_per_hour_to_ug_per_min(c: Column | str, ug_per_ml: float = 20.0) -> Column:
    """Infusion pump rate to mass rate; a negative rate is null (invalid)."""
    v = as_col(c)
    return F.when(v >= 0, v * ug_per_ml / 60.0)


def clip_action(c: Column | str, low: float = 0.0, high: float = 27.7) -> Column:
    """Per-step dose clipped to its limits, with the flag and the per-minute rate."""
    raw = as_col(c)
    applied = F.least(F.greatest(raw, F.lit(low)), F.lit(high))
    return F.struct(applied.alias("applied"), (applied != raw).alias("clipped"), (applied * 6.0).alias("rate_per_min"))


def james_lbm(sex: Column, height_cm: Column, weight_kg: Column) -> Column:
    q = (weight_kg / height_cm) * (weight_kg / height_cm)
    return F.when(sex == "male", 1.1 * weight_kg - 128.0 * q).when(sex == "female", 1.07 * weight_kg - 148.0 * q)


def schnider(age: Column, sex: Column, height: Column, weight: Column) -> dict[str, Column]:
    k = SCHNIDER
    lbm = james_lbm(sex, height, weight)
    return {
        "v1": F.lit(k["h1"]),
        "v2": k["h2"] - k["h3"] * (age - k["h4"]),
        "v3": F.lit(k["h5"]),
        "cl1": k["h6"] + k["h7"] * (weight - k["h8"]) - k["h9"] * (lbm - k["h10"]) + k["h11"] * (height - k["h12"]),
        "cl2": k["h13"] - k["h14"] * (age - k["h15"]),
        "cl3": F.lit(k["h16"]),
        "ke0": F.lit(k["h17"]),
    }


def minto(age: Column, sex: Column, height: Column, weight: Column, f12: Column | float) -> dict[str, Column]:
    k = MINTO
    da = age - k["f17"]
    dl = james_lbm(sex, height, weight) - k["f18"]
    return {
        "v1": k["f1"] - k["f2"] * da + k["f3"] * dl,
        "v2": k["f4"] - k["f5"] * da + k["f6"] * dl,
        "v3": F.lit(k["f7"]),
        "cl1": k["f8"] - k["f9"] * da + k["f10"] * dl,
        "cl2": k["f11"] - f12 * da,
        "cl3": k["f13"] - k["f14"] * da,
        "ke0": k["f15"] - k["f16"] * da,
    }


def rate_constants(p: Mapping[str, Column]) -> dict[str, Column]:
    return {
        "k10": p["cl1"] / p["v1"], "k12": p["cl2"] / p["v1"], "k13": p["cl3"] / p["v1"],
        "k21": p["cl2"] / p["v2"], "k31": p["cl3"] / p["v3"],
    }


def response_surface(ce_a: Column, ce_b: Column) -> Column:
    k = RESPONSE
    return k["baseline"] * F.pow(1.0 + ce_a / k["ce50_a"] + ce_b / k["ce50_b"], F.lit(-k["hill"]))


def inverse_distance_score(x: Column, target: float = 50.0, alpha: float = 1.0) -> Column:
    return 1.0 / (F.abs(F.lit(target) - x) + alpha)
