"""Names and score rules as column expressions."""

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ANN_NAME = r"^ann-(\d+)__x-(\d+)_y-(\d+)_w-(\d+)_h-(\d+)__ds-(\d+)\.png"
TILE_NAME = r"^tile_(?:(\d+)_)?x(\d+)_y(\d+)(?:_(gray|white)_matter)?(?:\.jpg)?$"


def base_name(path) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(base_name(path), r"(.)\.[^.]*$", "$1")


def parse_ann_name(name) -> Column:
    """Struct (ann_id, x, y, w, h, ds) of an annotation's file name; null if it doesn't match."""
    part = lambda i: F.regexp_extract(name, ANN_NAME, i)
    fields = F.struct(part(1).cast("bigint").alias("ann_id"), *(part(i + 2).cast("int").alias(c) for i, c in enumerate("xywh")), part(6).cast("int").alias("ds"))
    return F.when(F.col(name).rlike(ANN_NAME) if isinstance(name, str) else name.rlike(ANN_NAME), fields)


def ann_name(ann_id, x, y, w, h, ds) -> Column:
    return F.format_string("ann-%d__x-%d_y-%d_w-%d_h-%d__ds-%d.png", ann_id, x, y, w, h, ds)


def parse_flat_name(name, classes: Sequence[str]) -> Column:
    """Struct (scan, class, ann_name) of {scan}_{class}_ann-...; longer class names are tried first."""
    names = "|".join(re.escape(c) for c in sorted(classes, key=len, reverse=True))
    pattern = rf"^(.+?)_({names})_(ann-.*)$"
    parts = F.struct(*(F.regexp_extract(name, pattern, i + 1).alias(c) for i, c in enumerate(("scan", "class", "ann_name"))))
    return F.when(F.col(name).rlike(pattern), parts)


def strip_suffix(name, suffixes: Sequence[str]) -> Column:
    """The name without the first of the suffixes that it ends with, else null."""
    name = F.col(name)
    out = F.lit(None).cast("string")
    for s in reversed(suffixes):
        out = F.when(name.endswith(s), name.substr(F.lit(1), F.length(name) - len(s))).otherwise(out)
    return out


def extract_donor(name, ids: Sequence[str]) -> Column:
    """The first of the ids found in a name, longer ones first; null if there is none."""
    pattern = "|".join(rf"\Q{i}\E" for i in sorted(ids, key=lambda i: (-len(i), i)))
    return F.nullif(F.regexp_extract(name, f"({pattern})", 1), F.lit(""))


def max_number(text) -> Column:
    """The largest number in a text, null without any."""
    return F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)")), lambda x: x.cast("double")))


def safe_stem(name, limit: int = 100) -> Column:
    """A stem cut before '.rf.', or its MD5 where it is longer than the limit."""
    cut = F.substring_index(name, ".rf.", 1)
    return F.when(F.length(cut) > limit, F.md5(cut)).otherwise(cut)


def safe_token(text, empty: str = "Unclassified") -> Column:
    """Trimmed, spaces and other unusual characters as '_'; null is `empty`."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(F.trim(text), r"\s+", "_"), r"[^A-Za-z0-9_-]", "_"), F.lit(empty))


def label_path(path) -> Column:
    """An image's path to its label's: the first `images` folder becomes `labels`, the extension .txt."""
    swapped = F.regexp_replace(path, r"^((?:(?!/images/).)*)/images/", "$1/labels/")
    return F.regexp_replace(swapped, r"\.[^./]*$", ".txt")


def tile_name(x, y, tissue) -> Column:
    return F.format_string("tile_x%d_y%d_%s_matter.jpg", x, y, tissue)


def parse_tile(name) -> Column:
    """Struct (x, y, tissue) of a tile's file name; null if it doesn't match."""
    name = F.col(name) if isinstance(name, str) else name
    fields = F.struct(F.regexp_extract(name, TILE_NAME, 2).cast("int").alias("x"), F.regexp_extract(name, TILE_NAME, 3).cast("int").alias("y"), F.nullif(F.regexp_extract(name, TILE_NAME, 4), F.lit("")).alias("tissue"))
    return F.when(name.rlike(TILE_NAME), fields)


def scan_name(path) -> Column:
    """A slide's file name without its last extension, spaces as '_'."""
    return F.replace(stem(path), F.lit(" "), F.lit("_"))


def a_score(thal) -> Column:
    thal = F.col(thal) if isinstance(thal, str) else thal
    return F.when(thal.isNull(), None).when(thal <= 0, "A0").when(thal <= 2, "A1").when(thal <= 3, "A2").otherwise("A3")


def b_score(braak) -> Column:
    braak = F.col(braak) if isinstance(braak, str) else braak
    return F.when(braak.isNull(), None).when(braak <= 0, "B0").when(braak <= 2, "B1").when(braak <= 4, "B2").otherwise("B3")


def c_score(cerad) -> Column:
    cerad = F.col(cerad) if isinstance(cerad, str) else cerad
    return F.when(cerad.isNull(), None).when(cerad <= 0, "C0").when(cerad <= 1, "C1").when(cerad <= 2, "C2").otherwise("C3")


def ad_intensity(a, b, c) -> Column:
    """Not, Low, Intermediate or High from the three scores; null for combinations outside the table."""
    a, b, c = map(F.col, (a, b, c))
    return (
        F.when(a.isNull() | b.isNull() | c.isNull(), None)
        .when(a == "A0", F.when(c == "C0", "Not"))
        .when(b.isin("B0", "B1") | (a == "A1") & c.isin("C0", "C1"), "Low")
        .when((a == "A3") & (b == "B3") & c.isin("C2", "C3"), "High")
        .otherwise("Intermediate")
    )


def abc_string(a, b, c) -> Column:
    return F.concat_ws(", ", *(F.coalesce(F.col(x), F.lit("NA")) for x in (a, b, c)))


def pathology_group(diagnosis, intensity) -> Column:
    """Controls split by intensity: High and Intermediate have pathology, the rest and nulls have none."""
    d, i = F.col(diagnosis), F.col(intensity)
    return F.when(d != "100+", d).when(i.isin("High", "Intermediate"), "100+_with_pathology").when(d.isNotNull(), "100+_without_pathology")


def ordinal(value, ranks: Mapping[str, int]) -> Column:
    table = F.create_map(*(F.lit(x) for pair in ranks.items() for x in pair))
    return table[F.col(value)]


def stars(p) -> Column:
    p = F.col(p)
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")
