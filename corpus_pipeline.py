"""Training-corpus pipeline: language, near duplicates, benchmark text, source weights, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes to the shared folder and reads
again as the next one's docs. All but the last return the columns of documents.

Defined results: rows without a letter go in the first stage, so null and empty texts do; rows that share a
doc_id are one document and stay or go together; rows without one are told apart by their text where benchmark
text is looked for, and near copies among them all stay; in the mix, rows of one doc_id are all taken as often as
the one taken most; null labels teach nothing, and without any label every row goes; the null source is a source; an
empty table passes through every stage; columns of the table's own are carried whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.llm import decontaminate as benchmark
from talkloom.llm import grammar, language, mixing, near_duplicates
from talkloom.llm.shared import delete, new_path, scratch, stored


def least_share(n_labels: int) -> float:
    """Texts whose likeliest language has a smaller share of their words are rejected: nearly even shares, a
    fifteenth of the way from those to certainty (0.3 for four languages)."""
    return 1 / n_labels + (1 - 1 / n_labels) / 15 if n_labels else 1.0


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the field knows; those without letters or of no clear language go."""
    crf = language.train(docs)
    found = language.identify(docs, crf, carry=True)
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= least_share(len(crf.labels))))
    return kept.select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): that of smallest id."""
    gone = near_duplicates.near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    text = F.when(docs["doc_id"].isNull(), F.sha2(docs["text"].cast("string"), 256))
    found = benchmark.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key=text)
    gone = found.filter("contaminated").select("doc_id", "key").distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["doc_id"]) & text.eqNullSafe(gone["key"]), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    found = mixing.mix(docs, mixing.words_in(), F.array(F.col("source").cast("string")))
    times = found.filter("taken > 0").groupBy(F.col("doc_id").alias("taken_id")).agg(F.max(F.expr("cast(taken / size as int)")).alias("times"))
    # The row's own columns travel as one, so that their names meet no other.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    taken = rows.join(times, F.col("row.doc_id").eqNullSafe(F.col("taken_id")))
    return taken.select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as grammar-compressed token files; their index, read back."""
    import public_tokenizers

    path = new_path(spark, "tokens")
    grammar.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return grammar.token_index(grammar.read_tokens(spark, path))


STAGES = [
    ("language", keep_languages),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token files", write_token_files),
]
#: Languages are learned and tokens encoded, which SQL can't express; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents. Only the last stage's result and the token files stay in the shared folder."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if last:
            delete(spark, last)
        last = path
    return docs
