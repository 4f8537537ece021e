"""Column -> Column encodings: cells, periods, flags, eligibility (O-P01..P07, P10, P11, P13, P16, P18..P22, P32..P35)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Category sets and codes of the domain.
SIX_CELLS = ("1sg", "1pl", "2sg", "2pl", "3sg", "3pl")
POLITE, TRUE_PLURAL = "2pl_vy_polite_singular", "2pl_vy_true_plural"
FREQUENTIST_CELLS = ("1sg", "1pl", "2sg", TRUE_PLURAL)
COUNT_CELLS = ("1sg", "1pl", "2sg", POLITE, TRUE_PLURAL)
P1, P2, UNKNOWN = "P1_2014_2021", "P2_2022_plus", "unknown"
INVASION = "2022-02-24"
POOL = ("Ukrainian", "Russian")
STRATA = {"pooled_Ukrainian_Russian": POOL, "Ukrainian": ("Ukrainian",), "Russian": ("Russian",)}
CRIMEAN = ("Crimean Tatar", "Qirimli", "Crimean Tatar (Qirimli)")
SMALL_LANGUAGES = ("English", "Hebrew", "Polish", "Spanish", "French", "German", "Italian")
TRUTHY = ("true", "1", "yes", "y")


def blank_to_null(c: Column) -> Column:
    """Blank and the word nan are missing."""
    s = F.trim(c)
    return F.when((s == "") | (F.lower(s) == "nan"), None).otherwise(s)


def number_label(c: Column) -> Column:
    """Sg, Sing -> Singular; Pl, Plur -> Plural; others trimmed (O-P35)."""
    s = F.trim(c)
    return F.when(s.isin("Sg", "Sing"), "Singular").when(s.isin("Pl", "Plur"), "Plural").otherwise(s)


def six_way(person: Column, number: Column, other: str | None = "") -> Column:
    """Person x number cell; ``other`` where it is none (O-P01 blank, O-P02 NULL)."""
    p, n = F.coalesce(F.trim(person), F.lit("")), F.coalesce(F.trim(number), F.lit(""))
    digit = F.when(p.isin("1st", "2nd", "3rd"), F.substring(p, 1, 1))
    suffix = F.when(n.contains("Sing"), "sg").when(n.contains("Plur"), "pl")
    return F.coalesce(F.concat(digit, suffix), F.lit(other))


def register_cell(cell: Column, register: Column | None = None, addressee_singular: Column | None = None) -> Column:
    """2pl split by politeness; a known addressee number refines it, a missing one leaves it to the register (O-P03)."""
    if register is None:
        return F.when(cell == "2pl", TRUE_PLURAL).otherwise(cell)
    polite = F.coalesce(F.trim(register) == "polite_singular", F.lit(False))
    if addressee_singular is not None:
        polite = polite & F.coalesce(addressee_singular, F.lit(True))
    return F.when(cell != "2pl", cell).when(polite, POLITE).otherwise(TRUE_PLURAL)


def display_label(person: Column, number: Column) -> Column:
    """Label for tables: the six cells, Impersonal, or ambiguous (O-P04)."""
    cell = six_way(person, number)
    return F.when(cell != "", cell).when(F.trim(person) == "Impersonal", "Impersonal").otherwise("ambiguous")


def period_pre_post(year: Column) -> Column:
    return F.when(year.isNull(), UNKNOWN).when(year >= 2022, "post_2022").otherwise("pre_2022")


def period_p1_p2(year: Column) -> Column:
    """P1 2014-2021, P2 from 2022, else unknown (O-P06)."""
    return F.when(year >= 2022, P2).when(year >= 2014, P1).otherwise(UNKNOWN)


def period_three(year: Column) -> Column:
    return F.when(year.isNull(), UNKNOWN).when(year < 2014, "pre_2014").when(year < 2022, "2014_2021").otherwise("post_2022")


def period_by_date(day: Column) -> Column:
    """P1 and P2 cut at the day of the invasion (O-P06)."""
    d = F.to_date(day)
    return F.when(d >= F.lit(INVASION).cast("date"), P2).when(d >= F.lit("2014-01-01").cast("date"), P1).otherwise(UNKNOWN)


def reconciled_period(year: Column, label: Column) -> Column:
    """The year's period, else the given label, else unknown (O-P19)."""
    return F.coalesce(F.when(year.isNotNull(), period_p1_p2(year)), F.nullif(F.trim(label), F.lit("")), F.lit(UNKNOWN))


def sane_year(c: Column) -> Column:
    """Leading four-digit year or number in 1000..2100, else NULL (O-P21)."""
    y = F.regexp_extract(F.trim(c.cast("string")), r"^(\d{4})(?:\.0+)?(?:\D|$)", 1)
    y = F.when(y != "", y).cast("int")
    return F.when(y.between(1000, 2100), y)


def truthy(c: Column) -> Column:
    """Lenient boolean of a string: true, 1, yes, y; everything else and NULL is false (O-P07)."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*TRUTHY), F.lit(False))


def public_flag(c: Column) -> Column:
    return truthy(c)  # yes, y, 1, true: the same words (O-P10)


def is_translation(c: Column) -> Column:
    """A non-blank marker that is not nan (O-P11)."""
    return blank_to_null(c).isNotNull()


def language_reason(language: Column) -> Column:
    """Why a language is outside inference; blank when it is inside (O-P13)."""
    s = blank_to_null(language)
    return (
        F.when(s.isNull(), "empty_language").when(s.contains(","), "mixed_language_comma").when(s.isin(*CRIMEAN), "crimean_tatar_or_qirimli_family")
        .when(s.isin(*SMALL_LANGUAGES), "excluded_small_language_exact").when(~s.isin(*POOL), F.concat(F.lit("outside_pool_Ukrainian_Russian:"), s)).otherwise("")
    )


def qa_bucket(flag: Column) -> Column:
    """OK, INCONSISTENT:<rule word>, blank or other (O-P20)."""
    s = F.coalesce(F.trim(flag), F.lit(""))
    return F.when(s == "", "blank").when(s == "OK", "OK").when(s.startswith("INCONSISTENT"), "INCONSISTENT").otherwise("other")


def vocabulary(c: Column, allowed: list[str]) -> Column:
    """The value if allowed; unknown, blank and anything else become blank (O-P34)."""
    s = F.trim(F.coalesce(c, F.lit("")))
    return F.when(s.isin(*allowed), s).otherwise("")


def language_group(language: Column, major: list[str]) -> Column:
    return F.when(language.isin(*major), language).otherwise("Other")


def stratum_keeps(language: Column, stratum: str) -> Column:
    return language.isin(*STRATA[stratum])


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b as double; NULL where b is 0 or NULL (O-F25)."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def clipped_logit(p: Column, low: float = 1e-6, high: float | None = None) -> Column:
    """log(p / (1 - p)) with both terms kept in [low, 1 - low] or [low, high] (O-F24)."""
    top = 1 - low if high is None else high
    keep = lambda x: F.greatest(F.lit(low), F.least(F.lit(top), x))
    return F.log(keep(p) / keep(1 - p))


def exposure_column(kind: str) -> str:
    """Name of the exposure a model divides by (O-P22)."""
    names = {"stanzas": "exposure_n_stanzas", "tokens": "exposure_n_tokens", "finite_verbs": "exposure_n_finite_verbs", "finite_verbs_excl_imperative": "exposure_n_finite_verbs_excl_imperative"}
    if kind not in names:
        raise ValueError(f"unknown exposure {kind!r}; one of {sorted(names)}")
    return names[kind]


def primary_for_bh(stratum: Column) -> Column:
    """Does a stratum belong to the primary family of the adjustment (O-P16)? The pooled one does not; an unknown one gives NULL."""
    return F.when(stratum.isin(*(k for k, v in STRATA.items() if len(v) == 1)), True).when(stratum.isin(*STRATA), False)


def lookup(c: Column, table: dict[str, str], other: Column | None = None) -> Column:
    """A value through a small literal table (O-J09); values outside it become ``other``."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(m[c], other if other is not None else F.lit(None).cast("string"))
