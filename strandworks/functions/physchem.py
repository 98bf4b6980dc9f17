"""Physico-chemical features of amino-acid sequences and scores made from them, as native columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import seq

# Eisenberg's consensus hydrophobicity, a Boman-style solubility scale, average masses of free
# amino acids and of water, and the acid constants of side chains and chain ends (Bjellqvist).
EISENBERG = {"A": 0.62, "C": 0.29, "D": -0.90, "E": -0.74, "F": 1.19, "G": 0.48, "H": -0.40, "I": 1.38, "K": -1.50, "L": 1.06, "M": 0.64, "N": -0.78, "P": 0.12, "Q": -0.85, "R": -2.53, "S": -0.18, "T": -0.05, "V": 1.08, "W": 0.81, "Y": 0.26}
BOMAN = {"A": 0.17, "C": 0.24, "D": -1.23, "E": -2.02, "F": 1.13, "G": 0.01, "H": -0.96, "I": 0.31, "K": -0.99, "L": 0.56, "M": 0.23, "N": -0.42, "P": 0.45, "Q": -0.58, "R": -1.01, "S": -0.13, "T": -0.14, "V": 0.07, "W": 1.85, "Y": 0.94}
MASS = {"A": 89.0932, "C": 121.1582, "D": 133.1027, "E": 147.1293, "F": 165.1891, "G": 75.0666, "H": 155.1546, "I": 131.1729, "K": 146.1876, "L": 131.1729, "M": 149.2113, "N": 132.1179, "P": 115.1305, "Q": 146.1445, "R": 174.201, "S": 105.0926, "T": 119.1192, "V": 117.1463, "W": 204.2252, "Y": 181.1885}
WATER = 18.0153
POSITIVE = {"K": 10.0, "R": 12.0, "H": 5.98}
NEGATIVE = {"D": 4.05, "E": 4.45, "C": 9.0, "Y": 10.0}
N_END, N_END_OF = 7.5, {"A": 7.59, "M": 7.0, "S": 6.93, "P": 8.36, "T": 6.82, "V": 7.44, "E": 7.7}
C_END, C_END_OF = 3.55, {"D": 4.55, "E": 4.75}

FEATURES = ("length", "charge", "charge_density", "gravy", "moment", "aromaticity", "boman", "isoelectric_point", "mass", "entropy", "longest_run", "max_share", "cysteines")


def _sum(s: Column, table: dict[str, float]) -> Column:
    """Sum of a letter scale by counts of its letters."""
    total = F.lit(0.0)
    for c, v in table.items():
        total = total + seq.count_of(s, c) * v
    return total


def _constant(letter: Column, default: float, own: dict[str, float]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in own.items() for x in kv])
    return F.coalesce(F.try_element_at(table, letter), F.lit(default))


def charge_at(s: Column, ph: Column, counts: dict[str, Column] | None = None) -> Column:
    """Net charge: each group's share that is charged at that acidity; ``counts``: numbers of letters that are known."""
    number = lambda c: counts[c] if counts else seq.count_of(s, c)
    plus = lambda pk: 1 / (1 + F.pow(F.lit(10.0), ph - pk))
    minus = lambda pk: 1 / (1 + F.pow(F.lit(10.0), pk - ph))
    total = plus(_constant(F.substring(s, 1, 1), N_END, N_END_OF)) - minus(_constant(F.substring(s, -1, 1), C_END, C_END_OF))
    for c, pk in POSITIVE.items():
        total = total + number(c) * plus(F.lit(pk))
    for c, pk in NEGATIVE.items():
        total = total - number(c) * minus(F.lit(pk))
    return total


def isoelectric_point(s: Column, counts: dict[str, Column] | None = None) -> Column:
    """The acidity at which the charge vanishes, by halving [4.05, 12] from 7.775 on to a width of 0.0001."""
    state = lambda lo, hi, ph: F.struct(lo.alias("lo"), hi.alias("hi"), ph.alias("ph"))

    def halve(a: Column, _: Column) -> Column:
        def step(up: Column) -> Column:
            lo, hi = F.when(up, a["ph"]).otherwise(a["lo"]), F.when(up, a["hi"]).otherwise(a["ph"])
            return state(lo, hi, (lo + hi) / 2)

        # over one value, so that the charge is worked out once a step and not wherever it is named
        return F.when(a["hi"] - a["lo"] > 0.0001, F.get(F.transform(F.array(charge_at(s, a["ph"], counts) > 0), step), F.lit(0))).otherwise(a)

    return F.aggregate(F.sequence(F.lit(1), F.lit(20)), state(F.lit(4.05), F.lit(12.0), F.lit(7.775)), halve, lambda a: a["ph"])


def valid(s: Column) -> Column:
    return F.when(s.rlike(f"^[{seq.LETTERS}]+$"), s)


def features(s: Column, checked: bool = False, counts: dict[str, Column] | None = None) -> dict[str, Column]:
    """The thirteen features by name; for valid sequences (a null or other text gives nulls). ``checked``: s is valid() already."""
    s = s if checked else valid(s)
    n = F.length(s)
    charge = charge_at(s, F.lit(7.4))
    aromatic = sum((seq.count_of(s, c) for c in "FWY"), F.lit(0))
    values = (
        n.cast("double"), charge, charge / n, _sum(s, seq.HYDROPATHY) / n, seq.moment(s, EISENBERG), aromatic / n, _sum(s, BOMAN) / n, isoelectric_point(s, counts),
        _sum(s, MASS) - (n - 1) * WATER, seq.entropy(s), seq.longest_run(s).cast("double"), seq.max_share(s), seq.count_of(s, "C").cast("double"),
    )
    return dict(zip(FEATURES, values))


def window_moments(s: Column, widths: tuple[int, ...] = (8, 12), degrees: tuple[float, ...] = (100.0, 160.0)) -> dict[str, Column]:
    """The highest hydrophobic moment over windows, which are as wide as the string where it is shorter."""
    out = {}
    for w in widths:
        wide = F.least(F.length(s), F.lit(w))
        spans = F.sequence(F.lit(1), F.greatest(F.length(s) - wide + 1, F.lit(1)))
        for d in degrees:
            out[f"moment_{d:g}_window{w}"] = F.array_max(F.transform(spans, lambda i, w=wide, d=d: seq.moment(F.substring(s, i, w), EISENBERG, d)))
    return out


def interactions(columns: list[str]) -> dict[str, Column]:
    """Squares and products of every two columns."""
    return {f"{a}*{b}": F.col(a) * F.col(b) for i, a in enumerate(columns) for b in columns[i:]}


def to_value(x: Column) -> Column:
    """10^(6 - x): a negative decimal logarithm of moles as micromoles."""
    return F.pow(F.lit(10.0), 6 - x)


def trapezoid(x: Column, zero_low: float | None, full_low: float | None, full_high: float | None, zero_high: float | None) -> Column:
    """100 on the plateau, straight lines down to 0 at its feet; a side that is None has no slope; null stays null."""
    rise = F.lit(100.0) if full_low is None else 100 * (x - zero_low) / (full_low - zero_low)
    fall = F.lit(100.0) if full_high is None else 100 * (zero_high - x) / (zero_high - full_high)
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), rise, fall)))  # both pass nulls over


def level(flags: list[Column], high: int) -> Column:
    """Low without a flag, High from so many on, else Medium; null flags don't count."""
    n = sum((F.coalesce(f, F.lit(False)).cast("int") for f in flags), F.lit(0))
    return F.when(n >= high, "High").when(n > 0, "Medium").otherwise("Low")


def points(by: Column, table: dict[str, float]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), by)


# Fixed values of the developability rules, here and in the conditions and points below: hydrophobic letters and letters where chains are cut, a slope's
# four corners (score 0, 100, 100, 0) for each plain sub-score, the points of classes, the weights of sections.
HYDROPHOBIC, CUT = "AVILMFWYC", "KRFWYLM"
SLOPES = {
    "physicochemical": {"length": (5, 8, 30, 50), "mass": (500, 700, 3500, 5000), "charge": (-1, 0, 4, 6), "isoelectric_point": (4, 5, 10, 11), "gravy": (-2.0, -1.2, 0.2, 0.8), "aromaticity": (None, None, 0.25, 0.40), "entropy": (1.2, 2.0, None, None)},
    "stability": {"instability": (None, None, 40, 60), "hotspots": (None, None, 1, 6)},
    "solubility": {"hydrophobic": (None, None, 0.45, 0.70), "moment": (0.05, 0.15, 0.45, 0.65)},
    "synthesis": {"difficulty": (None, None, 3, 8), "length": (5, 8, 30, 60)},
    "safety": {"excess_charge": (None, None, 0, 4), "aromaticity": (None, None, 0.30, 0.50)},
}
WEIGHTS = {"physicochemical": 0.25, "stability": 0.25, "solubility": 0.25, "synthesis": 0.15, "safety": 0.10}
POINTS = {"proteolysis": {"Low": 100.0, "Medium": 60.0, "High": 20.0}, "aggregation": {"Low": 100.0, "Medium": 60.0, "High": 15.0}, "hemolysis": {"Low": 100.0, "Medium": 60.0, "High": 15.0}}
HOTSPOTS = ("N[GSTN]", "Q[GS]", "D[GSDT]", "DP", "CC", "M", "W", "C", "H", "^[GPEQ]")


def synthesis_difficulty(s: Column, hydrophobic: Column) -> Column:
    """Points for what makes a chain hard to build; each rule is (condition, points)."""
    n, cys = F.length(s), seq.count_of(s, "C")
    rules = [
        (n > 30, 2), (n > 50, 2), (s.rlike("[IVT]{4}"), 3), (s.rlike(f"[{HYDROPHOBIC}]{{6}}"), 3), (hydrophobic > 0.55, 2), (cys % 2 == 1, 2), (cys >= 4, 2),
        (seq.count_of(s, "H") > 0.20 * n, 1), (seq.count_of(s, "M") >= 2, 1), (s.contains("DP"), 1), (s.rlike("Q{4}|G{5}|(?:GS){4}"), 1),
    ]
    return sum((F.when(c, p).otherwise(0) for c, p in rules), F.lit(0))


def instability(s: Column, weights: dict[str, float]) -> Column:
    """Ten over the length times the sum of a table's weights of neighbouring letters; pairs that the table lacks count 1.

    The table, letter pair -> weight, is the caller's: it has some 400 values.
    """
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.create_map().cast("map<string,double>")
    pairs = F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.coalesce(F.try_element_at(table, F.substring(s, i, 2)), F.lit(1.0)))
    return F.when(F.length(s) >= 2, F.lit(10.0) / F.length(s) * F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x))


def developability(df, text: str, weights: dict[str, float] | None = None):
    """The rows with the features, risks, sections, score, class and the list of reasons of the hard filter.

    ``weights``: the table of instability(), which makes the column of that name; without it the rows' own
    column counts. A section is the mean of its parts that are known; a null index leaves its parts and rules out.
    """
    if weights is not None:
        df = df.withColumn("instability", instability(F.col(text), weights))
    # the valid text and its charged letters' numbers are columns, worked out once a row
    charged = {c: f"_n{c}" for c in (*POSITIVE, *NEGATIVE)}
    known = df.withColumns({"_valid": valid(F.col(text)), **{n: seq.count_of(valid(F.col(text)), c) for c, n in charged.items()}})
    s = F.col(text)
    made = features(F.col("_valid"), True, {c: F.col(n) for c, n in charged.items()})
    out = known.select(*df.columns, *[c.alias(k) for k, c in made.items()]).withColumn("hydrophobic", sum((seq.count_of(s, c) for c in HYDROPHOBIC), F.lit(0)) / F.length(s))
    f = F.col
    unstable = lambda x: F.coalesce(f("instability") > x, F.lit(False))
    clean = F.array_max(F.transform(F.split(F.regexp_replace(s, "(?<=.)P", "K"), f"[{CUT}]"), F.length))
    density = sum((seq.count_of(s, c) for c in CUT), F.lit(0)) / F.length(s)
    out = out.withColumns({
        "clean_stretch": clean, "hotspots": seq.motif_count(s, *HOTSPOTS), "difficulty": synthesis_difficulty(s, f("hydrophobic")), "excess_charge": F.greatest(f("charge") - 6, F.lit(0.0)),
        "aggregation": level([(f("hydrophobic") >= 0.45) | (f("gravy") > 0.5), F.abs("charge") < 1, f("aromaticity") >= 0.25, unstable(40)], 3),
        "hemolysis": level([f("charge") > 6, f("moment") > 0.5, f("gravy") > 0.5, f("hydrophobic") > 0.5], 3),
        "proteolysis": F.when((clean < 5) | (density > 0.45) | F.substring(s, 2, 1).isin("P", "A"), "High").when((clean < 10) | (density > 0.25), "Medium").otherwise("Low"),
    })
    soluble = sum((c.cast("int") for c in (f("gravy") <= 0.5, _sum(s, EISENBERG) / F.length(s) <= 0.4, F.abs("charge") >= 1, F.coalesce(f("instability") < 40, F.lit(True)))), F.lit(0))
    first = F.substring(s, 1, 1)
    more = {
        "physicochemical": [],
        "stability": [F.when(first.isin(*"GAVPMST"), 100.0).when(first.isin(*"RKLFWYI"), 35.0).otherwise(70.0), points(f("proteolysis"), POINTS["proteolysis"])],
        "solubility": [F.when(soluble >= 3, 100.0).when(soluble == 2, 65.0).otherwise(25.0), points(f("aggregation"), POINTS["aggregation"])],
        "synthesis": [F.when(f("cysteines") % 2 == 0, 100.0).otherwise(20.0)],
        "safety": [points(f("hemolysis"), POINTS["hemolysis"])],
    }
    for section, slopes in SLOPES.items():
        parts = [trapezoid(f(c), *corners) for c, corners in slopes.items()] + more[section]
        known = F.array_compact(F.array(*parts))
        out = out.withColumn(section, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(known), F.lit(0)))
    score = sum((f(c) * w for c, w in WEIGHTS.items()), F.lit(0.0))
    reasons = F.array_compact(F.array(
        F.when(f("aggregation") == "High", "high_aggregation_risk"), F.when(f("hemolysis") == "High", "high_hemolysis_risk"), F.when(f("difficulty") >= 8, "spps_difficulty_at_least_8"),
        F.when(unstable(60) & (f("clean_stretch") < 5), "severe_instability_and_proteolysis"), F.when(f("cysteines") % 2 == 1, "odd_cysteine_count"),
    ))
    grade = F.when(score >= 80, "Excellent").when(score >= 65, "Good").when(score >= 50, "Moderate").otherwise("Low")
    return out.withColumns({"developability": score, "class": grade, "reasons": reasons})
