"""Fill-in-middle transformation: texts cut at two ranks of their units, found in an indexable skip list.

A unit is a run of A-Z and a-z or any other single code point. A text's units form a skip list whose links carry two
widths, the units and the code points they pass. A cut is given as a number of units; the descent from the highest lane
adds up widths until that rank is reached, and so yields the place as code points. Only these places leave the Python
task: parts, output and digests are made of the text by Spark's own functions.

Defined results: a null text is an empty one and stays plain; a null doc_id draws from the empty string; repeated rows
draw alike; a very long text is read in blocks and cut as a whole; an empty table gives no rows; columns other than id
and text are ignored, whatever their names.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of documents that are rearranged, and of these the percent with the suffix first.
RATE, SPM = 90, 20
#: Links of a lane for one of the next, and bytes of a text read at once.
STEP, BLOCK = 4, 1 << 22


def unit_widths(raw: np.ndarray) -> np.ndarray:
    """Code points of each unit of a UTF-8 text."""
    found, points, last = [], 0, False
    for i in range(0, len(raw), BLOCK):
        b = raw[i : i + BLOCK]
        letter, first = (b | 32) - np.uint8(97) < 26, (b & 0xC0) != 0x80
        before = np.concatenate(([last], letter[:-1]))
        index = np.cumsum(first)
        found.append(points + index[first & ~(letter & before)] - 1)
        points, last = points + int(index[-1]), letter[-1]
    return np.diff(np.concatenate([*found, [points]]).astype(np.int64))


class SkipList:
    """Units of a text in lanes: `units` and `points` are the widths of a lane's links, `below` the places of its nodes in the next lower lane.

    Lane k keeps unit i if the fraction of i times the golden ratio is under 4^-k. Such units lie at nearly even
    distances, so a descent passes a few links of each lane whatever the text."""

    def __init__(self, widths: np.ndarray):
        self.lanes = [(np.ones(len(widths), np.int64), widths, None)]
        height = np.arange(len(widths), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        limit = 1 << 64
        while len(height) > STEP:
            limit //= STEP
            below = np.flatnonzero(height < np.uint64(limit))
            units, points, _ = self.lanes[-1]
            self.lanes.append((np.add.reduceat(units, below), np.add.reduceat(points, below), below))
            height = height[below]

    def seek(self, rank: int) -> int:
        """Code points before the unit of a rank (as many as there are for the rank after the last)."""
        node = passed = 0
        for units, points, below in reversed(self.lanes):
            while node < len(units) and units[node] <= rank:
                rank -= int(units[node])
                passed += int(points[node])
                node += 1
            if not rank:
                break
            node = int(below[node]) if below is not None else node
        return passed


def _places(text: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
    out = []
    for t, a, b in zip(text, one.to_pylist(), two.to_pylist(), strict=True):
        widths = unit_widths(np.frombuffer(t.as_buffer(), np.uint8))
        n, units = len(widths), SkipList(widths)
        low, high = sorted((a % (n + 1), b % (n + 1)))
        first = units.seek(low)
        out.append((n, first, units.seek(high) - first))
    n, first, second = zip(*out, strict=True) if out else ([], [], [])
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (n, first, second)], ["n", "prefix", "middle"])


def draws(doc_id: Column) -> list[Column]:
    """Four unsigned 32-bit numbers of an id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n, form, prefix_chars, middle_chars, output): form is plain, psm or spm; lengths in code points, null if plain."""
    h1, h2, h3, h4 = draws(F.col("doc_id"))
    places = F.arrow_udf(_places, "n long, prefix long, middle long")
    rows = texts(docs, id_col, text_col).withColumns({"h3": h3, "h4": h4}).withColumn("cut", places("text", h1, h2))
    text = F.col("text")
    plain = (text == "") | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE) | (F.col("h3") % 100 >= RATE)
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < SPM, "spm").otherwise("psm"))
    a, b = F.col("cut.prefix").cast("int"), F.col("cut.middle").cast("int")
    prefix, middle, suffix = F.substring(text, F.lit(1), a), F.substring(text, a + 1, b), F.substring(text, a + b + 1, F.length(text))
    psm, spm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle), F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    form, cut = F.col("form"), F.col("form") != "plain"
    output = F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)
    return rows.select("doc_id", "text", F.col("cut.n").alias("n"), "form", F.when(cut, F.col("cut.prefix")).alias("prefix_chars"), F.when(cut, F.col("cut.middle")).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text of an output and its form. A text with a marker stays plain, so the markers are where an output splits."""
    parts = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def op13_fill_middle(spark, sf_dir: str) -> DataFrame:
    found = transform(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    restored = restore(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))
