"""Language identification by Bayesian evidence fusion.

Evidence: the text's byte n-gram likelihoods, the language that the markup declares, a language code in the address
(country suffix, first label or path segment), and a prior of the host. The likelihood tables of declared values and
address codes and the hosts' priors come from grouped counts of the languages that the texts alone suggest, over all
rows. A host's prior is drawn to its parent domain's, that to its suffix's, and that to the whole table's, each by as
many pseudo-rows as STRENGTH says; so hosts with few rows follow their surroundings.

A text whose n-grams are much less familiar, over all languages alike, than those of labelled texts is in none of them:
it is rejected, and tells nothing about its host.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillspan.llm import bytekernel as bk
from quillspan.llm.shared import extended, written

UNKNOWN = "und"
BITS, GRAM = 16, 3
SAMPLE_ROWS = 600  # labelled rows of each language that the fit sees at most
SAMPLE_CHARS = 16384  # the fit sees the beginning of longer texts; they are identified whole
STRENGTH = 8.0  # pseudo-rows of each smoothing step
POWER = 0.75  # n-grams overlap and repeat: n of them weigh as n ** POWER would
FAR = 9.0  # standard deviations below the labelled texts' familiarity at which a text is in no known language
UNSEEN = np.array([-np.inf, 1.0, 1.0])

_letters = np.full(256, 0x20, np.uint8)
_letters[0x61:0x7B] = np.arange(0x61, 0x7B)
_letters[0x41:0x5B] = np.arange(0x61, 0x7B)
_letters[0x80:] = np.arange(0x80, 0x100)


@dataclass
class TextModel:
    """Log probabilities of n-gram buckets by language; fits a broadcast whatever the corpus."""

    languages: list[str]
    table: np.ndarray
    level: np.ndarray  # of known texts' mean n-gram familiarity: its mean, its variance, and that of one n-gram

    def familiar(self) -> np.ndarray:
        """By bucket, the log probability under all languages alike: a text that mixes languages is as familiar as one that doesn't."""
        top = self.table.max(axis=0)
        return top + np.log(np.exp(self.table - top).mean(axis=0))

    def log_likelihoods(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of n-grams with letters, their mean log likelihoods, and whether they are too unfamiliar, of each row."""
        bucket, used = _grams(buf, offs)
        rows = len(offs) - 1
        seen = np.concatenate([[0], np.cumsum(used)])
        n = seen[offs[1:]] - seen[offs[:-1]]

        def means(by_bucket: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0.0], np.cumsum(np.where(used, by_bucket[bucket], 0), dtype=np.float64)])
            return (sums[offs[1:]] - sums[offs[:-1]]) / np.maximum(n, 1)

        out = np.zeros((rows, len(self.languages)))
        for k in range(len(self.languages)):
            out[:, k] = means(self.table[k])
        mean, between, within = self.level
        far = mean - FAR * np.sqrt(between + GRAM * within / np.maximum(n, 1))
        return n, out, (n > 0) & (means(self.familiar()) < far) if self.languages else np.zeros(rows, bool)


def _grams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram from each byte on, and whether it counts: inside its row, with a letter."""
    n = len(buf)
    x = _letters[buf]
    h = np.zeros(n, np.uint32)
    letter = np.zeros(n, bool)
    for k in range(GRAM):
        h[: n - k] = h[: n - k] * np.uint32(0x01000193) + x[k:] + np.uint32(1)
        letter[: n - k] |= x[k:] != 0x20
    used = letter
    for k in range(1, GRAM):
        ends = offs[1:] - k
        used[ends[(ends >= 0) & (ends >= offs[:-1])]] = False
    return (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS), used


def _fit_tables(texts: list[str], langs: list[str], languages: list[str]) -> np.ndarray:
    counts = np.full((len(languages), 1 << BITS), 0.5)
    for k, lang in enumerate(languages):
        for _, buf, offs in bk.blocks(pa.array([t for t, x in zip(texts, langs) if x == lang], pa.large_string())):
            bucket, used = _grams(buf, offs)
            counts[k] += np.bincount(bucket[used], minlength=1 << BITS)
    return np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def fit_texts(texts: list[str], langs: list[str]) -> TextModel:
    """Tables from all texts; each half of them is measured with the tables of the other half for the level."""
    languages, seen = sorted(set(langs)), []
    for half in (0, 1):
        other = TextModel(languages, _fit_tables(texts[1 - half :: 2], langs[1 - half :: 2], languages), UNSEEN)
        by_bucket = other.familiar() if languages else np.zeros(0)
        for _, buf, offs in bk.blocks(pa.array(texts[half::2], pa.large_string())):
            bucket, used = _grams(buf, offs)
            for a, z in zip(offs[:-1], offs[1:]):
                x = by_bucket[bucket[a:z][used[a:z]]]
                if len(x):
                    seen.append((x.mean(), x.var(), len(x)))
    level = UNSEEN
    if len(seen) >= 8:  # too few texts show no level
        mean, var, n = np.array(seen).T
        level = np.array([mean.mean(), max(mean.var() - (var.mean() / n).mean(), 0.01), var.mean()])
    return TextModel(languages, _fit_tables(texts, langs, languages), level)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> TextModel:
    """A text model from at most SAMPLE_ROWS rows of each declared language, those of least hash; fitted in one task."""
    usable = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.trim(text_col) != ""))
    usable = usable.select(F.substring(text_col, 1, SAMPLE_CHARS).alias("text"), F.lower(lang_col).alias("lang"), F.xxhash64(*docs.columns).alias("hash"))
    # About twice the wanted rows of each language, those of low hash, so that a bounded number of rows moves.
    share = usable.groupBy("lang").agg((F.lit(2.0 * SAMPLE_ROWS + 50) / F.count("*") * (1 << 31)).alias("below"))
    usable = usable.join(F.broadcast(share), "lang").where(F.pmod("hash", F.lit(1 << 31)) < F.col("below"))
    least = W.partitionBy("lang").orderBy("hash", "text")
    sample = usable.withColumn("n", F.row_number().over(least)).where(F.col("n") <= SAMPLE_ROWS).select("text", "lang")

    def run(batches):
        rows = [r for b in batches for r in b.to_pylist()]
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(fit_texts([r["text"] for r in rows], [r["lang"] for r in rows]))], pa.binary())})

    found = sample.coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(found["model"]) if found else fit_texts([], [])


def text_evidence(rows: DataFrame, model: TextModel, text_col: str) -> DataFrame:
    """rows without text_col, with n_grams, text_ll, the weighed log likelihood of each of the model's languages, and foreign."""
    rest = [c for c in rows.columns if c != text_col]
    base = rows.select(*rest, text_col)
    shared = rows.sparkSession.sparkContext.broadcast(model)  # 256 KB for each language
    schema = extended(rows.select(*rest), "n_grams long, text_ll array<double>, foreign boolean")

    def run(batches):
        model = shared.value
        for batch in batches:
            ns, lls, far = [], [], []
            for _, buf, offs in bk.blocks(batch.column(len(rest))):
                n, ll, unfamiliar = model.log_likelihoods(buf, offs)
                ns.append(n)
                lls.append(ll * (n**POWER)[:, None])
                far.append(unfamiliar)
            if not ns:
                continue
            flat = np.concatenate(lls)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(np.concatenate(ns)), lists, pa.array(np.concatenate(far))], names=[*rest, "n_grams", "text_ll", "foreign"])

    return base.mapInArrow(run, schema)


def _counts(languages: list[str]) -> list[Column]:
    return [F.sum(F.when(F.col("text_lang") == x, 1.0).otherwise(0.0)) for x in languages]


def _smoothed(table: DataFrame, above: str | Column) -> Column:
    """(counts + STRENGTH * distribution above) / (rows + STRENGTH), by language."""
    total = F.aggregate("counts", F.lit(0.0), lambda a, x: a + x) + STRENGTH
    return F.zip_with("counts", above, lambda x, p: (x + STRENGTH * p) / total)


def _prior_table(rows: DataFrame, languages: list[str]) -> DataFrame:
    """(host, prior, n): hosts' language distributions, smoothed over parent domain, suffix and the whole."""
    voting = rows.where("host is not null").select("host", F.coalesce("parent", "host").alias("parent"), F.coalesce("suffix", F.lit("")).alias("suffix"), "text_lang")
    hosts = voting.groupBy("host", "parent", "suffix").agg(F.array(*_counts(languages)).alias("counts"), F.count("*").alias("n"))
    hosts = written(hosts, "hosts")  # a row for each host

    def up(keys: list[str]) -> DataFrame:
        return hosts.groupBy(*keys).agg(F.array(*[F.sum(F.col("counts")[k]) for k in range(len(languages))]).alias("counts"))

    uniform = 1.0 / len(languages)
    root = up([]).first()["counts"]  # a number for each language
    root = [x or 0.0 for x in root]
    whole = F.array(*[F.lit((x + STRENGTH * uniform) / (sum(root) + STRENGTH)) for x in root])
    suffix = up(["suffix"])
    suffix = suffix.select("suffix", _smoothed(suffix, whole).alias("p1"))
    parent = up(["parent", "suffix"]).join(suffix, "suffix")
    parent = parent.select("parent", "suffix", _smoothed(parent, "p1").alias("p2"))
    return hosts.join(parent, ["parent", "suffix"]).select("host", _smoothed(hosts, "p2").alias("prior"), "n")


def _likelihood_table(rows: DataFrame, value: str, languages: list[str]) -> DataFrame:
    """(value, log P(value | language), n): counts by language, smoothed towards the value's share of all rows."""
    by = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.array(*_counts(languages)).alias("counts"), F.count("*").alias("n"))
    totals = by.agg(F.array(*[F.sum(F.col("counts")[k]) for k in range(len(languages))]).alias("n")).first()["n"]
    totals = [x or 0.0 for x in totals]  # a number for each language
    share = (F.aggregate("counts", F.lit(0.0), lambda a, x: a + x) + 1) / (sum(totals) + 1)
    ll = F.zip_with("counts", F.array(*[F.lit(x) for x in totals]), lambda x, n: F.log((x + STRENGTH * share) / (n + STRENGTH)))
    return by.select(value, ll.alias(f"{value}_ll"), "n")


def address_columns(url: Column, languages: list[str]) -> dict[str, Column]:
    """host, parent, suffix and hint of addresses; hint is a known language code that is the host's suffix, its first label or a path segment."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    labels = F.split(host, r"\.")
    suffix = F.element_at(labels, -1)
    parent = F.when(F.size(labels) > 2, F.concat_ws(".", F.slice(labels, 2, F.size(labels) - 1))).otherwise(host)
    path = F.split(F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))), "/")
    known = F.array(*[F.lit(x) for x in languages]) if languages else F.array().cast("array<string>")
    hint = F.get(F.array_intersect(F.concat(F.array(suffix, F.get(labels, F.lit(0))), path), known), F.lit(0))
    return {"host": host, "parent": parent, "suffix": suffix, "hint": hint}


def identified(rows: DataFrame, model: TextModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """rows (with text_col, declared, host, parent, suffix, hint) without the text, with language, posterior, text_language and rejected.

    Rejected, with language 'und', are rows whose text is null or blank, rows whose text is in no known language, rows
    whose best posterior is below `least`, and rows whose text has no n-gram with a letter and that declare no language
    and have no hint; a text such as 'A.' is decided by its other evidence. Any evidence may be null and is then left
    out. Repeated rows count as often as they stand and get the same result; an empty table stays empty; further columns
    are kept whatever their names, but those named as the new ones are replaced.
    """
    made = ["language", "posterior", "text_language", "rejected"]
    evidence = ["declared", "host", "parent", "suffix", "hint"]
    rest = [c for c in rows.columns if c not in (text_col, *made)]
    languages = model.languages
    if not languages:
        blank = rows.select(*rest, F.lit(UNKNOWN).alias("language"), F.lit(0.0).alias("posterior"), F.lit(None).cast("string").alias("text_language"))
        return blank.withColumn("rejected", F.lit(True))
    named = F.array(*[F.lit(x) for x in languages])
    flat = F.array(*[F.lit(1.0 / len(languages))] * len(languages))
    says = F.coalesce(F.rlike(text_col, F.lit(r"\S")), F.lit(False))
    base = rows.select(F.struct(*rest).alias("rest"), *evidence, says.alias("says"), F.col(text_col).alias("text"))
    found = text_evidence(base, model, "text")
    best = F.when((F.col("n_grams") > 0) & ~F.col("foreign"), F.get(named, F.array_position("text_ll", F.array_max("text_ll")).cast("int") - 1))
    found = written(found.withColumn("text_lang", best), "evidence")
    out = found.join(_prior_table(found, languages).drop("n"), "host", "left")
    score = F.zip_with("text_ll", F.coalesce("prior", flat), lambda a, p: a + F.log(p))
    for value in ("declared", "hint"):
        out = out.join(_likelihood_table(found, value, languages).drop("n"), value, "left")
        score = F.zip_with(score, F.coalesce(f"{value}_ll", F.transform(named, lambda x: F.lit(0.0))), lambda a, b: a + b)
    out = out.withColumn("score", score).withColumn("top", F.array_max("score"))
    out = out.withColumn("posterior", 1 / F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    told = (F.col("n_grams") > 0) | F.col("declared").isNotNull() | F.col("hint").isNotNull()
    rejected = ~F.col("says") | F.col("foreign") | ~told | (F.col("posterior") < least)
    language = F.when(rejected, F.lit(UNKNOWN)).otherwise(F.get(named, F.array_position("score", F.col("top")).cast("int") - 1))
    return out.select(
        *(F.col("rest").getField(c).alias(c) for c in rest), language.alias("language"), "posterior", F.col("text_lang").alias("text_language"), rejected.alias("rejected")
    )


def of_documents(docs: DataFrame, key: list[Column]) -> DataFrame:
    """documents as evidence rows: the lang column is what is declared, the source stands for the host."""
    none = F.lit(None).cast("string")
    host = F.col("source").cast("string")
    return docs.select(*key, "text", F.lower("lang").alias("declared"), host.alias("host"), host.alias("parent"), none.alias("suffix"), none.alias("hint"))


def of_pages(pages: DataFrame, key: list[Column], languages: list[str]) -> DataFrame:
    """pages as evidence rows: main text, the html element's lang, and the address."""
    from quillspan.llm.extraction import extract

    lang = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<html[^>]*?\slang\s*=\s*[\"']?([a-z]+)", 1))
    rows = extract(pages.withColumn("declared", F.nullif(lang, F.lit(""))), text_col="text")
    return rows.select(*key, "text", "declared", *(c.alias(n) for n, c in address_columns(F.col("url"), languages).items()))


def language_report(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """A row for each document and each page: kind, doc_id, page_id, language, posterior, text_language, declared, kept."""
    model = train(docs)
    none = F.lit(None).cast("long")
    rows = of_documents(docs, [F.lit("document").alias("kind"), F.col("doc_id").cast("long").alias("doc_id"), none.alias("page_id")])
    rows = rows.unionByName(of_pages(pages, [F.lit("page").alias("kind"), none.alias("doc_id"), F.col("page_id").cast("long").alias("page_id")], model.languages))
    found = identified(rows, model)
    return found.select("kind", "doc_id", "page_id", "language", "posterior", "text_language", "declared", (~F.col("rejected")).alias("kept"))
