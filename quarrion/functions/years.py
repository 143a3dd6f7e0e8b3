"""Release years from model and name: an ordered chain of patterns with number ladders."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import ladder, number

#: A rule that matches without giving a year still ends the chain.
_STOP = -1

# Thresholds of model numbers and their years, the last being the year below all of them.
LADDERS = {
    "MT": ([(9900, 2025), (9800, 2024), (9200, 2023), (8700, 2022), (8300, 2021), (8000, 2020), (7900, 2019), (7500, 2018), (7000, 2017), (6500, 2016), (6000, 2015), (5000, 2014)], 2013),
    "DIMENSITY": ([(9400, 2025), (9200, 2024), (9000, 2023), (8300, 2024), (8200, 2023), (8000, 2022), (7200, 2023), (6000, 2022), (1100, 2021), (1000, 2020), (900, 2019), (800, 2018), (700, 2017), (600, 2016), (500, 2015)], 2014),
    "KIRIN": ([(9010, 2024), (9000, 2020), (8000, 2024), (990, 2019), (980, 2018), (970, 2017), (960, 2016), (930, 2015), (900, 2014), (700, 2018), (600, 2015)], 2013),
    "SM": ([(8750, 2025), (8650, 2024), (8550, 2023), (8450, 2022), (8350, 2021), (8250, 2020), (8150, 2019), (8000, 2018), (7000, 2017), (6000, 2016), (5000, 2015), (4000, 2014), (3000, 2013), (2000, 2012)], 2011),
    "MSM": ([(9000, 2018), (8998, 2017), (8996, 2016), (8994, 2015), (8974, 2013), (8960, 2012), (8900, 2011), (8200, 2010), (7600, 2009), (7200, 2008)], 2007),
    "EXYNOS": ([(2500, 2025), (2400, 2024), (2200, 2022), (2100, 2021), (2000, 2020), (1580, 2025), (1480, 2024), (1380, 2023), (1280, 2022), (1080, 2020)], 2005),
    "A": ([(18, 2025), (17, 2024), (16, 2023), (15, 2022), (14, 2020), (13, 2019), (12, 2018), (11, 2017), (10, 2016), (9, 2015), (8, 2014), (7, 2013)], None),
    "M": ([(4, 2025), (3, 2023), (2, 2022), (1, 2020)], _STOP),
    "SC": ([(8380, 2022), (8280, 2021), (8180, 2019), (7280, 2021), (7180, 2020)], 2018),
    "SA": ([(8295, 2021), (8255, 2024), (6155, 2019)], 2018),
    "SNAPDRAGON": ([(855, 2019), (845, 2018), (835, 2017), (820, 2016), (810, 2015), (600, 2014), (400, 2013)], 2012),
    "S": ([(928, 2020), (922, 2019), (905, 2016), (812, 2015), (805, 2014), (802, 2013)], 2012),
    "T": ([(960, 2016), (950, 2015), (920, 2018)], 2014),
    "KOMPANIO": ([(800, 2022), (500, 2021)], 2020),
    "KIRIN_T": ([(92, 2025), (91, 2024), (90, 2023), (80, 2020)], _STOP),
}


def _whole(n: Column, by: int) -> Column:
    return F.floor(n / by).cast("int")


def _parts(t: Column, vendor: Column) -> tuple[Column, Column]:
    """Year of one upper-case text by the first rules, and by those after them.

    _STOP where a rule ends the chain without a year; null where none matches.
    """

    def n(pattern: str, group: int = 1) -> Column:
        return number(t, pattern, group)

    def stepped(pattern: str, name: str) -> tuple[Column, Column]:
        return t.rlike(pattern), ladder(n(pattern), *LADDERS[name])

    def plus(pattern: str, base: int, by: int = 1, less: int = 0) -> tuple[Column, Column]:
        return t.rlike(pattern), F.lit(base) + _whole(n(pattern) - less, by)

    am, ahfr, atom = r"\b([AM])(\d+)\b", r"\b([AHFR])(\d{2,3})", r"ATOM\s+([DN])(\d{4})"
    letter = lambda p: F.regexp_extract(t, p, 1)
    k, a = n(ahfr, 2), n(am, 2)
    gen, xgen = r"SNAPDRAGON\s*(\d+)\s*GEN\s*(\d+)", r"XR(\d+)\s*(?:GEN\s*(\d+))?"
    g, gx = r"\bG(\d+)\s*GEN\s*(\d+)", r"\bG(\d+)X\s*GEN\s*(\d+)"
    early = [
        stepped(r"MT(\d{4})", "MT"),
        stepped(r"(?:DIMENSITY|HELIO)\s*(\d{3,4})", "DIMENSITY"),
        stepped(r"KIRIN\s*(\d{3,4})", "KIRIN"),
        stepped(r"(?:SM|SDM)(\d{3,4})", "SM"),
        stepped(r"(?:MSM|APQ)(\d{4})", "MSM"),
        stepped(r"(?s)EXYNOS.*?(\d{4})", "EXYNOS"),
        (t.rlike(r"(?s)EXYNOS.*?\d{3}"), F.when(n(r"(?s)EXYNOS.*?(\d{3})") >= 850, 2020).otherwise(2015)),
        (t.rlike(r"EXYNOS\s+W\d+"), F.when(n(r"EXYNOS\s+W(\d+)") >= 930, 2023).otherwise(2020)),
        (t.rlike(r"EXYNOS\s+AUTO\s*V\d+"), F.when(n(r"EXYNOS\s+AUTO\s*V(\d+)") >= 920, 2023).otherwise(2020)),
        (t.rlike(r"SNAPDRAGON\s*X\s*(?:ELITE|PLUS)") & ~t.rlike(r"X\s*2"), F.lit(2024)),
        (t.rlike(r"SNAPDRAGON\s*X\s*2"), F.lit(2025)),
        (t.rlike(gen), F.when(n(gen) >= 8, 2021).otherwise(2020) + n(gen, 2)),
        plus(r"RK(\d{4})", 2008, 200, 2000),
        (t.rlike(am), F.when(letter(am) == "A", F.coalesce(ladder(a, *LADDERS["A"]), F.lit(2006) + a)).otherwise(ladder(a, *LADDERS["M"]))),
        plus(r"TEGRA\s*(\d+)", 2008),
        (t.rlike(r"\bT(?:[01]\d{2}|20[0-9])\b"), F.lit(2008) + n(r"\bT([01]\d|20)\d\b")),
        (t.rlike(r"(?:TE|T)\d{3}X1"), F.lit(2015)),
    ]
    # This one sets a year and lets the chain go on.
    aside = F.when(t.rlike(r"(?i)\b[xzn]\d+"), F.when(t.rlike(r"(?i)x\d"), 2015).when(t.rlike(r"(?i)z\d{4}"), 2014))
    late = [
        (t.rlike(g), F.when(n(g) == 1, F.lit(2020) + n(g, 2)).when(n(g) == 3, F.when(n(g, 2) >= 3, F.lit(2021) + n(g, 2)).otherwise(2021)).otherwise(F.lit(2020) + n(g, 2) + (n(g) > 1).cast("int"))),
        (t.rlike(gx), F.when(n(gx, 2) == 1, 2021).otherwise(F.lit(2021) + n(gx, 2))),
        plus(r"MICROSOFT\s+SQ(\d+)", 2018),
        plus(r"\bQCS(\d{3})\b", 2015, 100),
        stepped(r"\bSC(\d{4})", "SC"),
        stepped(r"\bSA(\d{4})P?\b", "SA"),
        (t.rlike(r"WEAR\s*\d+"), F.lit(2020)),
        plus(r"W\d+\+?\s*GEN\s*(\d+)", 2021),
        (t.rlike(xgen), F.coalesce(F.lit(2020) + n(xgen, 2), F.when(n(xgen) >= 2, 2019).otherwise(2018))),
        stepped(r"SNAPDRAGON\s+(\d{3})", "SNAPDRAGON"),
        (t.rlike(r"\bQSD\d{4}\b"), F.lit(2009)),
        plus(r"\bSW(\d{4})\b", 2015, 1000),
        plus(r"\bCE(\d{4})\b", 2008, 1000),
        (t.rlike(r"\bOMAP\d{4}\b"), F.lit(2004) + n(r"\bOMAP(\d)\d{3}\b") * 2),
        (
            t.rlike(ahfr),
            F.when(letter(ahfr) == "F", F.when(k >= 100, 2015).otherwise(2013))
            .when(letter(ahfr) == "R", F.when(k >= 40, F.lit(2012) + _whole(k, 10)).otherwise(2014))
            .when(letter(ahfr) == "H", ladder(k, [(700, F.lit(2018) + _whole(k - 700, 2)), (600, F.lit(2015) + _whole(k - 600, 2)), (500, F.lit(2017) + _whole(k - 500, 2)), (300, F.lit(2014) + _whole(k - 300, 2))], 2013))
            .otherwise(F.coalesce(ladder(k, [(100, F.lit(2014) + _whole(k - 100, 10)), (80, 2014), (40, 2015), (31, 2013), (13, 2012), (10, 2011)]), F.lit(2011) + _whole(k, 5))),
        ),
        stepped(r"\bS(\d{3})", "S"),
        ((vendor == "Amlogic") & t.rlike(r"\bT\d{3}"), ladder(n(r"\bT(\d{3})"), *LADDERS["T"])),
        stepped(r"KOMPANIO\s*(\d+)", "KOMPANIO"),
        (t.rlike(atom), F.when(letter(atom) == "D", F.lit(2010) + _whole(n(atom, 2), 1000)).otherwise(F.lit(2009) + _whole(n(atom, 2), 500))),
        plus(r"\bJZ(\d{4})\b", 2005, 1000),
        (t.rlike(r"\bTHOR\b"), F.lit(2025)),
        plus(r"F1[CE](\d{3})", 2014, 100),
        plus(r"AIOT\s*I(\d{3})", 2020, 100),
        plus(r"\bSP(\d{4})\b", 2010, 100, 9000),
        plus(r"\bUMS(\d{4})\b", 2018, 200, 9000),
        (t.rlike(r"\bK3V2"), F.when(t.contains("K3V2E"), 2013).otherwise(2012)),
        (t.rlike(r"\bT\d{2,3}") & t.contains("KIRIN"), F.when(n(r"\bT(\d{2,3})") >= 80, ladder(n(r"\bT(\d{2,3})"), *LADDERS["KIRIN_T"])).otherwise(F.coalesce(aside, F.lit(_STOP)))),
    ]

    def first(rules: list[tuple[Column, Column]]) -> Column:
        return F.coalesce(*[F.when(fits, year.cast("int")) for fits, year in rules])

    return first(early), F.coalesce(first(late), aside.cast("int"))


def infer_year(model: Column, name: Column, vendor: Column) -> Column:
    """The year that the model gives, else the name; null if a rule for the model ends without one."""
    found = F.coalesce(*_parts(F.upper(model), vendor), *_parts(F.upper(name), vendor))
    return F.when(found != _STOP, found)


#: What a text needs to have for any rule to match.
_ANY = r"\d|THOR|SNAPDRAGON"


def with_inferred_year(df: DataFrame, out: str, barrier: Callable[[DataFrame], DataFrame], wanted: Column) -> DataFrame:
    """Adds infer_year of a frame's model, name and vendor where it is wanted, part by part, so that each is compiled.

    A text that no rule can match, or that comes after one that gave a year,
    is null to the rules and costs none of their patterns.
    """
    vendor = F.coalesce("vendor", F.lit(""))
    found = []
    for c in ("model", "name"):
        for part in (0, 1):
            t = F.upper(F.coalesce(c, F.lit("")))
            todo = reduce(lambda x, y: x & y, [F.col(f).isNull() for f in found], wanted)
            name = f"_{c}_{part}"
            df = barrier(df.withColumn("_t", F.when(todo & t.rlike(_ANY), t)))
            df = barrier(df.withColumn(name, _parts(F.col("_t"), vendor)[part]))
            found.append(name)
    year = F.coalesce(*found)
    return df.withColumn(out, F.when(year != _STOP, year)).drop("_t", *found)
