"""Token counts through a digest cache: texts are encoded once per tokenizer version, whatever copies and runs follow.

The cache is a folder of Parquet files: `tokenizer=<version digest>/batch=<id>/`, rows (digest of the content, count). A run
notes each document's digest, looks for digests that the cache lacks, brings one text of each of these to an encoder and
appends its count as a new batch; then every document takes its count from the cache. Only whole batches are ever added,
so runs may share a cache and a run that dies adds nothing or all of a batch; a digest that two runs added counts once.

The version digest covers the library, its version and the file's bytes, and every task checks that its copy of the file
is the one the driver saw. Content is normalised only as far as no tokenizer can tell the difference: a null text is the
empty one, and the text is its UTF-8 bytes. Case, white space or Unicode forms change counts, so they stay.

Defined results: an empty text has the count the library gives (0, or more for a tokenizer that adds pieces of its own);
null and repeated doc_ids are rows of their own; a very long text is encoded whole; an empty table gives no rows and
leaves the cache as it is; columns other than id and text are ignored, whatever their names.
"""

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator
from importlib.metadata import version as library_version

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, kept, shared_dir, slices, stored, texts
from .packing import Encoder

LIMIT = 1024
#: The vocabulary whose stretches packing can encode apart (two bytes an id).
PACKED = "byte_bpe_50k"
#: Digests a run lacks (32 bytes each) up to which they are sent to the tasks that read texts; beyond, they are joined.
BROADCAST_ROWS = 500_000
#: A digest of at least this share of all documents is hot: at most so many can be, and their counts are sent to the tasks.
HOT_SHARE = 1000
#: Characters encoded in one call of the library; its threads would each keep memory of their own, and Spark's tasks fill the cores already.
SLICE = 1 << 16


def tokenizer_version(path: str) -> str:
    """Hex digest of what decides the counts: library, version and file."""
    library = "tokenizers" if path.endswith(".json") else "sentencepiece"
    with open(path, "rb") as f:
        return hashlib.sha256(f"{library} {library_version(library)}\n".encode() + f.read()).hexdigest()


def counter(path: str, version: str) -> Callable[[list[str]], list[int]]:
    """The library's counts of texts: no special tokens are added, special strings in a text are taken as its default does, nothing is cut or padded.

    Texts of the vocabulary that packing knows go through packing's encoder: the same library's ids, each repeated stretch of text encoded once."""
    if tokenizer_version(path) != version:
        raise ValueError(f"{path} is not the tokenizer that the driver read")
    if path == public_tokenizers.path(f"{PACKED}.json"):
        encode = Encoder(PACKED)
        return lambda batch: [len(ids) // 2 for ids in encode(batch)]
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        return lambda batch: [len(e.ids) for e in t.encode_batch_fast(batch, add_special_tokens=False)]
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=path)
    return lambda batch: [len(ids) for ids in p.encode(batch, add_bos=False, add_eos=False, num_threads=1)]


def _encode(path: str, version: str):
    def task(batches) -> Iterator[pa.RecordBatch]:
        count = kept(("counts", path, version), lambda: counter(path, version))
        for batch in slices(batches):
            found, part, size = [], [], 0
            for t in batch.column("text"):
                part.append(t.as_py())
                size += len(part[-1])
                if size >= SLICE:
                    found += count(part)
                    part, size = [], 0
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(found + count(part), pa.int64())], ["digest", "n_tokens"])

    return task


def cached(spark, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of a tokenizer version in the cache, a row per digest."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{cache}/tokenizer={version}")
    rows = "digest binary, n_tokens long"
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], rows)
    return spark.read.schema(rows).option("recursiveFileLookup", True).parquet(str(folder.toString())).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, cache: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) by the tokenizer file of `path`; counts that the folder `cache` lacks are added to it."""
    spark, version = docs.sparkSession, tokenizer_version(path)
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    seen = stored(texts(docs, id_col, text_col).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), digest), "digests")
    classes = stored(seen.groupBy("digest").agg(F.count("*").alias("copies")), "classes")
    known = cached(spark, cache, version)
    missing = stored(classes.select("digest").join(known, "digest", "left_anti"), "missing")
    n = missing.count()
    if n:
        one = texts(docs, id_col, text_col).select(digest, "text")
        if n <= BROADCAST_ROWS:
            one = one.join(F.broadcast(missing), "digest", "left_semi").dropDuplicates(["digest"])
        else:  # copies meet within tasks first, so that a hot text is no large group
            one = one.dropDuplicates(["digest"]).join(missing, "digest", "left_semi")
        counts = one.mapInArrow(_encode(path, version), "digest binary, n_tokens long")
        counts.write.parquet(f"{cache}/tokenizer={version}/batch={uuid.uuid4().hex}")
        known = cached(spark, cache, version)
    discard(missing)
    least = max(seen.count() // HOT_SHARE, 1000)
    hot = stored(classes.where(F.col("copies") >= least).join(known, "digest").select("digest", "n_tokens"), "hot")
    often = seen.join(F.broadcast(hot), "digest")
    seldom = seen.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(known, "digest")
    discard(classes)
    return often.unionByName(seldom).select("doc_id", "n_bytes", "n_tokens")


def op11_token_counts(spark, sf_dir: str) -> DataFrame:
    """Counts of all documents, starting with an empty cache."""
    cache = f"{shared_dir(spark)}/cellmorph-token-counts-{uuid.uuid4().hex}"
    found = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), cache)
    return found.withColumn("over_limit", F.col("n_tokens") > LIMIT)
