"""Language identification by Bayesian fusion of text, markup, address and host.

For every language the posterior multiplies

* the likelihood of the text's letter trigrams, from a multinomial model fitted on a
  bounded sample of every label's rows (neighbouring trigrams depend on each other, so a
  text counts as ``EVIDENCE`` independent ones at most);
* how often a declared markup language, and an address suffix, go with the language;
* the host's prior, smoothed towards that of its domain, and that towards all rows'.

The last three are counted over all rows with the text's own posterior as weight, by
grouped aggregation, and joined back by value; a hot host is a few rows here as well.
A row that lacks one kind of evidence is judged by the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickreports.llm import texts
from clickreports.llm.steps import Steps
from clickreports.llm.url_filters import host_of

TRAINING_ROWS = 20_000  # of each label
BUCKETS = 1 << 14
MAX_LANGUAGES = 400
EVIDENCE = 40.0
SMOOTHING = 1.0  # of declared languages and suffixes, in rows
HOST_STRENGTH = 10.0  # rows of a domain's prior that a host's own rows outweigh
THRESHOLD = 0.5
DRAWS = 1 << 52  # of the hash that samples
# A text with a trigram: three bytes in a row of letters and spaces, a letter among them.
_WIDE = "\\x{80}-\\x{7FF}"  # letters of two bytes
_NARROW = "A-Za-z \\x09-\\x0D"
HAS_TRIGRAM = (
    f"[\\x{{800}}-\\x{{10FFFF}}]|[{_WIDE}][{_NARROW}{_WIDE}]|[{_NARROW}][{_WIDE}]"
    f"|[A-Za-z][{_NARROW}]{{2}}|[{_NARROW}][A-Za-z][{_NARROW}]|[{_NARROW}]{{2}}[A-Za-z]"
)


@dataclass(frozen=True)
class TextModel:
    """Log probabilities of trigram buckets, a row per language."""

    languages: tuple[str, ...]
    logs: np.ndarray


def _trigrams(block: texts.Block) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every run of three bytes of letters, spaces folded to one class.

    Bytes of longer code points count as letters; digits, marks and controls break a run.
    """
    low = texts.lower_ascii(block.data)
    letter = ((low >= 97) & (low <= 122)) | (low >= 128)
    space = texts.is_space(low)
    codes = np.where(space, 32, low).astype(np.uint64)
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    usable = letter | space
    good = usable[:-2] & usable[1:-1] & usable[2:] & (letter[:-2] | letter[1:-1] | letter[2:])
    at = np.flatnonzero(good)
    rows = block.rows_of(at)
    whole = at + 3 <= block.offsets[rows + 1]
    at, rows = at[whole], rows[whole]
    grams = codes[at] << np.uint64(16) | codes[at + 1] << np.uint64(8) | codes[at + 2]
    return rows, (texts.mix(grams) % np.uint64(BUCKETS)).astype(np.int64)


def fit(labelled: DataFrame, text_column: str = "text", label_column: str = "lang", id_column: str | None = "doc_id") -> TextModel:
    """The trigram model of the labelled rows, a hash sample of about ``TRAINING_ROWS`` of every label.

    Labels of fewer rows are learned whole; the hash is of id and text, and the row with a
    label's smallest hash is always taken. Rows without label or trigrams are left out, and
    so are labels without any other. More than ``MAX_LANGUAGES`` labels are refused: the driver
    gets one number per language and bucket, and every row one per language.
    """
    keys = [F.col(c) for c in (id_column, text_column) if c in labelled.columns]
    draw = F.pmod(F.xxhash64(*keys, F.lit("fit")), F.lit(DRAWS))
    rows = labelled.select(F.col(label_column).alias("lang"), F.col(text_column).alias("text"), draw.alias("draw"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(HAS_TRIGRAM))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.min("draw").alias("least"))
    sizes = sizes.limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels with texts; these are hardly languages")
    languages = tuple(sorted(r["lang"] for r in sizes))
    last = {r["lang"]: max(r["least"], int(min(1.0, TRAINING_ROWS / r["rows"]) * DRAWS)) for r in sizes}
    lasts = F.create_map(*[F.lit(x) for pair in last.items() for x in pair])
    sample = rows.where(F.col("draw") <= lasts[F.col("lang")]) if last else rows.limit(0)
    sample = sample.select("lang", "text")
    number = {lang: i for i, lang in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((max(1, len(languages)), BUCKETS), dtype=np.int64)
        for batch in batches:
            of = np.array([number.get(x, -1) for x in batch.column("lang").to_pylist()], dtype=np.int64)
            for block in texts.blocks(batch.column("text")):
                rows, buckets = _trigrams(block)
                lang = of[block.lo + rows]
                flat = lang[lang >= 0] * BUCKETS + buckets[lang >= 0]
                counts += np.bincount(flat, minlength=counts.size).reshape(counts.shape)
        lang, bucket = np.nonzero(counts)
        columns = [pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(counts[lang, bucket])]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "n"])

    each = sample.mapInArrow(run, "lang int, bucket int, n long")
    totals = each.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((len(languages), BUCKETS), 0.1)
    if len(languages):
        lang, bucket, n = (np.asarray(totals.column(c).combine_chunks()) for c in ("lang", "bucket", "n"))
        counts[lang, bucket] += n
    return TextModel(languages, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))


def _likelihoods(model: TextModel):
    """Adds ``letters``, the number of trigrams, and ``scores``, a log likelihood per language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters, scores = [], []
            for block in texts.blocks(batch.column("__text")):
                rows, buckets = _trigrams(block)
                n = np.bincount(rows, minlength=len(block))
                logs = [np.bincount(rows, weights=line[buckets], minlength=len(block)) for line in model.logs]
                scale = np.minimum(1.0, EVIDENCE / np.maximum(n, 1))
                letters.append(n)
                scores.append(np.stack(logs, axis=1) * scale[:, None])
            flat = np.concatenate(scores).ravel() if scores else np.zeros(0)
            width = len(model.languages)
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * width)
            lists = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.float64()))
            counts = pa.array(np.concatenate(letters).astype(np.int64) if letters else np.zeros(0, np.int64))
            columns = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "__text"]
            names = [name for name in batch.schema.names if name != "__text"]
            yield pa.RecordBatch.from_arrays([*columns, counts, lists], [*names, "letters", "scores"])

    return run


def _normalized(logs: Column) -> Column:
    """Probabilities from unnormalized logs."""
    top = F.array_max(logs)
    powers = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, b: a + b)
    return F.transform(powers, lambda p: p / total)


def _counts(rows: DataFrame, key: Column, languages: int, by: list[str]) -> DataFrame:
    """Per value of ``key`` the rows' text posteriors summed by language."""
    sums = [F.sum(F.element_at("belief", i + 1)) for i in range(languages)]
    return rows.where(key.isNotNull()).groupBy(*by).agg(F.array(*sums).alias("sums"))


def _row_key(docs: DataFrame) -> Column:
    """128 bits of all columns of a row: rows that differ in any have different ones, equal rows the same."""
    columns = [docs[f"`{c}`"] for c in docs.columns]
    # A null leaves a hash as it is, so which columns are null is hashed too.
    nulls = [c.isNull() for c in columns]
    return F.array(*[F.xxhash64(F.lit(seed), *nulls, *columns) for seed in (1, 2)])


def identify(
    docs: DataFrame,
    model: TextModel,
    evidence: DataFrame | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    host_column: str | None = None,
) -> DataFrame:
    """Language of every row of ``docs``: ``id``, ``lang``, ``probability``, the evidence, ``accepted``, ``row``.

    ``row`` is a key of the whole row, by which ``accepted_rows`` finds it again.
    ``evidence`` has ``doc_id``, ``declared`` and ``url``; of several rows with an id the smallest
    counts. ``host_column`` names a column of ``docs`` that stands for the host where there is no
    URL with one. A row is rejected if its text is null, empty or without three letters or
    spaces in a row, or if no language reaches ``THRESHOLD``; of equal probabilities the
    first language by name counts. With a model of no language every row is rejected and
    ``lang`` is null. Repeated rows are judged each, and so are rows without an id, which have no
    evidence. Declared languages compare by their first part in lower case (``en-GB`` as
    ``en``); blank ones, and URLs without a host, are no evidence.
    """
    steps = Steps(docs.sparkSession)
    languages = len(model.languages)
    none = F.lit(None).cast("string")
    own_host = F.lower(F.trim(F.col(host_column).cast("string"))) if host_column else none
    rows = docs.select(
        F.col(id_column).alias("id"), own_host.alias("own_host"), _row_key(docs).alias("row"), F.col(text_column).alias("__text")
    )
    kind = rows.schema["id"].dataType.simpleString()
    if not languages:
        blank = [none.alias(c) for c in ("declared", "suffix", "host")]
        return rows.select(
            "id", none.alias("lang"), none.cast("double").alias("probability"), *blank, F.lit(False).alias("accepted"), "row"
        )
    schema = f"id {kind}, own_host string, row array<long>, letters long, scores array<double>"
    scored = steps.land("texts", rows.mapInArrow(_likelihoods(model), schema))
    if evidence is None:
        scored = scored.select("*", none.alias("said"), none.alias("url"))
    else:
        one = evidence.groupBy(F.col("doc_id").alias("id")).agg(F.min(F.struct("declared", "url")).alias("e"))
        one = one.select("id", F.col("e.declared").alias("said"), F.col("e.url").alias("url"))
        scored = scored.join(one, "id", "left")
    said = F.lower(F.regexp_extract(F.trim("said"), "^([A-Za-z]+)", 1))
    address = host_of(F.col("url"))
    host = F.coalesce(address, F.when(F.col("own_host") != "", F.col("own_host")))
    scored = scored.select(
        "id",
        "row",
        "letters",
        "scores",
        F.when(said != "", said).alias("declared"),
        F.when(address.contains("."), F.substring_index(address, ".", -1)).alias("suffix"),
        host.alias("host"),
        F.substring_index(host, ".", -2).alias("domain"),
        _normalized(F.col("scores")).alias("belief"),
    )
    scored = steps.land("scored", scored)
    lettered = scored.where("letters > 0")

    def sum_of(column: str) -> Column:
        return F.aggregate(column, F.lit(0.0), lambda a, b: a + b)

    total = lettered.agg(F.array(*[F.sum(F.element_at("belief", i + 1)) for i in range(languages)]).alias("sums")).first()
    base = [(x or 0.0) + SMOOTHING for x in total["sums"]]
    overall = F.array(*[F.lit(x / sum(base)) for x in base])
    prior = F.transform(F.array(*[F.lit(x) for x in base]), lambda x: F.log(x))

    def likelihood(column: str) -> DataFrame:
        """log P(value | language), up to a constant per value; smoothed by ``SMOOTHING`` rows."""
        each = _counts(lettered, F.col(column), languages, [column])
        logs = F.zip_with("sums", prior, lambda n, all_of: F.log(n + SMOOTHING * 0.1) - all_of)
        return steps.land(column, each.select(column, logs.alias(f"{column}_logs")))

    domains = _counts(lettered, F.col("host"), languages, ["domain"])
    domains = domains.withColumn("all", sum_of("sums") + HOST_STRENGTH)
    smooth = F.zip_with("sums", overall, lambda n, p: (n + HOST_STRENGTH * p))
    domains = domains.select("domain", F.transform(smooth, lambda x: x / F.col("all")).alias("prior"))
    hosts = _counts(lettered, F.col("host"), languages, ["host", "domain"]).join(domains, "domain")
    hosts = hosts.withColumn("all", sum_of("sums") + HOST_STRENGTH)
    smooth = F.zip_with("sums", "prior", lambda n, p: (n + HOST_STRENGTH * p))
    logs = F.transform(smooth, lambda x: F.log(x / F.col("all")))
    hosts = steps.land("hosts", hosts.select("host", logs.alias("host_logs")))
    fused = scored.join(likelihood("declared"), "declared", "left").join(likelihood("suffix"), "suffix", "left")
    fused = fused.join(hosts, "host", "left")
    nothing = F.array(*[F.lit(0.0)] * languages)
    logs = F.zip_with("scores", F.coalesce("declared_logs", nothing), lambda a, b: a + b)
    logs = F.zip_with(logs, F.coalesce("suffix_logs", nothing), lambda a, b: a + b)
    logs = F.zip_with(logs, F.coalesce("host_logs", F.transform(overall, lambda p: F.log(p))), lambda a, b: a + b)
    judged = fused.withColumn("posterior", _normalized(logs)).withColumn("probability", F.array_max("posterior"))
    names = F.array(*[F.lit(x) for x in model.languages])
    at = F.array_position("posterior", F.col("probability")).cast("int")
    return judged.select(
        "id",
        F.element_at(names, at).alias("lang"),
        "probability",
        "declared",
        "suffix",
        "host",
        ((F.col("letters") > 0) & (F.col("probability") >= THRESHOLD)).alias("accepted"),
        "row",
    )


def page_evidence(pages: DataFrame) -> DataFrame:
    """``doc_id``, ``declared``, ``url``: what a document's page says, by the number that ends its path.

    Of several pages of a document the one with the smallest id counts. Pages whose
    address has no number are left out. The declared language is the lang attribute of
    the page's html tag.
    """
    rows = pages.select(
        F.expr("try_cast(regexp_extract(url, '^[^?#]*?/([0-9]+)(?:[.][a-z]+)?/?(?:[?#].*)?$', 1) AS BIGINT)").alias("doc_id"),
        F.regexp_extract("html", r"""(?i)<html[^>]*?\slang\s*=\s*["']?([A-Za-z-]+)""", 1).alias("declared"),
        "url",
        "page_id",
    )
    first = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min(F.struct("page_id", "declared", "url")).alias("page")
    )
    return first.select("doc_id", "page.declared", "page.url")


def accepted_rows(docs: DataFrame, found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that are accepted in ``found``, the result for ``docs``.

    Every row goes by its own verdict, also where rows share an id or have none.
    """
    gone = found.where("NOT accepted").select(F.col("id").alias("__id"), F.col("row").alias("__row")).distinct()
    gone = Steps(docs.sparkSession).land("rejected", gone)
    same = docs[id_column].eqNullSafe(gone["__id"]) & (_row_key(docs) == gone["__row"])
    return docs.join(gone, same, "left_anti")
