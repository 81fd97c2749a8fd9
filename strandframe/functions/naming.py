"""Names of graph nodes and paths, undirected edges, colours and small statistics, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Colours of phase -1, 0 and 1.
PHASE_COLOURS = ("Cornflower Blue", "Plum", "Tomato")


def edge(a: str, b: str) -> tuple[Column, Column]:
    """Both ends of an undirected edge, the lesser first."""
    return F.least(a, b), F.greatest(a, b)


def alt_name(name: Column) -> Column:
    """Partner of ``<prefix>.0`` or ``<prefix>.1``; null for other names."""
    side = F.regexp_extract(name, r"\.([01])$", 1)
    return F.when(side != "", F.concat(F.regexp_extract(name, r"^(.*)\.[01]$", 1), F.lit("."), (1 - side.cast("int")).cast("string")))


def split_path_name(name: Column) -> tuple[Column, Column]:
    """Component and haplotype of ``<component>.<haplotype>``."""
    return F.regexp_extract(name, r"^(.*)\.([0-9]+)$", 1), F.regexp_extract(name, r"^(.*)\.([0-9]+)$", 2).cast("int")


def phase_colour(partition: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, PHASE_COLOURS)), partition + 2)


def component_label(name: Column) -> Column:
    """Last but one of the dot-separated parts."""
    return F.try_element_at(F.split(name, r"\."), F.lit(-2))


def log2_ratio(a: Column, b: Column, epsilon: float = 1e-12) -> Column:
    return F.log2((a + epsilon) / (b + epsilon))


def binomial_p(n: Column, k: Column) -> Column:
    """Probability of exactly ``k`` of ``n`` fair draws; by logarithms, so any n will do."""
    log_choose = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(0.0), lambda acc, i: acc + F.when(k > 0, F.log((n - k + i).cast("double")) - F.log(i.cast("double"))).otherwise(0.0))
    return F.exp(log_choose - n * F.log(F.lit(2.0)))


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    """#RRGGBB of three shares from 0 to 1."""
    return F.concat(F.lit("#"), *[F.lpad(F.conv(F.round(255 * x).cast("int").cast("string"), 10, 16), 2, "0") for x in (r, g, b)])


#: Ends and middle of the colour maps, as shares of red, green and blue; colours between them are mixed.
COLOUR_MAPS = {
    "coolwarm": ((0.23, 0.30, 0.75), (0.87, 0.87, 0.87), (0.71, 0.02, 0.15)),
    "viridis": ((0.27, 0.00, 0.33), (0.13, 0.57, 0.55), (0.99, 0.91, 0.14)),
    "magma": ((0.00, 0.00, 0.02), (0.72, 0.21, 0.47), (0.99, 0.99, 0.75)),
    "plasma": ((0.05, 0.03, 0.53), (0.80, 0.28, 0.47), (0.94, 0.98, 0.13)),
    "rainbow": ((0.50, 0.00, 1.00), (0.50, 1.00, 0.71), (1.00, 0.00, 0.00)),
}


def clamped(x: Column, saturation: float) -> Column:
    """``x / saturation`` cut to -1 .. 1 and moved to 0 .. 1."""
    return (F.least(F.greatest(x / saturation, F.lit(-1.0)), F.lit(1.0)) + 1) / 2


def map_colour(share: Column, name: str = "coolwarm") -> Column:
    """#RRGGBB of a share from 0 to 1 on a colour map."""
    low, mid, high = COLOUR_MAPS[name]
    mix = lambda a, b, t: a + (b - a) * t
    part = lambda i: F.when(share < 0.5, mix(F.lit(low[i]), F.lit(mid[i]), share * 2)).otherwise(mix(F.lit(mid[i]), F.lit(high[i]), share * 2 - 1))
    return hex_colour(part(0), part(1), part(2))


def rgb(hex_: Column) -> Column:
    """Red, green and blue (0 to 255) of #RRGGBB."""
    return F.array(*[F.conv(F.substring(hex_, i, 2), 16, 10).cast("int") for i in (2, 4, 6)])


def blended(a: Column, b: Column, share: float = 0.5, gamma: float = 2.2) -> Column:
    """#RRGGBB between two colours, mixed in linear light."""
    x, y = rgb(a), rgb(b)
    mix = lambda i: F.sqrt((1 - share) * F.pow(F.get(x, i) / 255, F.lit(gamma)) + share * F.pow(F.get(y, i) / 255, F.lit(gamma)))
    return hex_colour(*[mix(F.lit(i)) for i in range(3)])


def is_bubble(a: Column, b: Column) -> Column:
    """Whether two names are the sides of one bubble: the same prefix, and sides 0 and 1."""
    return F.coalesce(alt_name(a) == b, F.lit(False))


def chromosome_order(name: Column) -> Column:
    """Sort key: numbers in their order, then letters."""
    bare = F.regexp_replace(name, "^(?i)chr", "")
    number = F.regexp_extract(bare, r"^(\d+)", 1)
    return F.when(number != "", F.concat(F.lit("0"), F.lpad(number, 6, "0"), bare)).otherwise(F.concat(F.lit("1"), bare))


# Flags of an alignment.
def is_first_mate(flag: Column) -> Column:
    return flag.bitwiseAND(64) != 0


def is_second_mate(flag: Column) -> Column:
    return flag.bitwiseAND(128) != 0


def is_primary(flag: Column) -> Column:
    """Not secondary; supplementary rows pass."""
    return flag.bitwiseAND(256) == 0


def is_supplementary(flag: Column) -> Column:
    return flag.bitwiseAND(2048) != 0


def strand(is_reverse: Column) -> Column:
    return F.when(is_reverse, "-").otherwise("+")


def forward_range(is_reverse: Column, start: Column, stop: Column, length: Column) -> Column:
    """(start, stop) on the forward strand of a range on the strand given."""
    return F.struct(F.when(is_reverse, length - stop).otherwise(start).alias("start"), F.when(is_reverse, length - start).otherwise(stop).alias("stop"))


def haplotype_of_name(name: Column) -> Column:
    """0 or 1 for names that end so behind a dot; null for others."""
    return F.nullif(F.regexp_extract(name, r"\.([01])$", 1), F.lit("")).cast("int")


def qv_identity(qv: Column) -> Column:
    """Identity of a quality value."""
    return 1 - F.pow(F.lit(10.0), -qv / 10)
