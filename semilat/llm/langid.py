"""Language identification by Bayesian fusion of evidence.

Text: byte trigrams of the lower-cased letters, hashed into BUCKETS, with a smoothed multinomial for each language and a
uniform one for "none of them" (`UNKNOWN`). Trigrams are counted over all labelled rows by grouped aggregation, so that
every label is a language at every size; the driver gets at most BUCKETS counts a language. All statistics below cover all
data, too.

Grouped aggregation then sums the rows' votes (text posteriors, weighed by how sure and how long they are) by declared language, by
address suffix, and by host, domain and top domain. A declared language or suffix changes the odds by how much its rows' languages differ from all rows'. A host's
prior is smoothed towards its domain's, that towards its top domain's, and that towards the whole table's; a row's own part
in its host's sum is taken out. A row's score is the text's log likelihood (tempered, since trigrams overlap) plus the
logarithms of these.

Nulls: a null or letterless text has no text evidence and is `UNKNOWN`; null or unseen declared languages and suffixes say
nothing; a null host is a host of its own. Repeated rows count each. Without labelled rows all is `UNKNOWN`.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, map_batches

UNKNOWN = "und"
BITS = 15
BUCKETS = 1 << BITS
#: Languages whose counts a task holds at a time.
HELD = 64
TEMPER, SMOOTHING, UNKNOWN_PRIOR, ALPHA = 0.5, 5.0, 1e-3, 0.02
HALF_VOTE = 50
#: Against the uniform model this share of a language's trigrams may be any, so that new words don't make a text foreign.
UNSEEN_SHARE = 0.2

#: Maps ASCII letters to lower case and other ASCII to spaces; bytes of further letters stay.
LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
# Markup that holds no text, and the declaration of a page's language.
UNSEEN = re.compile(r"<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
DECLARED = r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([a-zA-Z]{2,8})"


def trigrams(text: str) -> np.ndarray:
    """Bucket of each trigram of the letters of a text; words are set off by single spaces."""
    words = text.lower().encode().translate(LETTERS).split()
    if not words:
        return np.zeros(0, np.int64)
    b = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # by bucket: log probability of each language, and of each with UNSEEN_SHARE mixed in

    def log_likelihoods(self, text: str) -> np.ndarray | None:
        """By language, of the uniform model, and of it as it stands to the best language if new words are allowed for; None without letters."""
        at = trigrams(text)
        if not len(at):
            return None
        own, mixed = self.table[at].sum(axis=0, dtype=np.float64).reshape(2, -1)
        uniform = -len(at) * np.log(BUCKETS)
        return np.append(own, [uniform, uniform + own.max() - mixed.max()])


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    def run(batches):
        held = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if lang not in held:
                    if len(held) == HELD:
                        yield from map(counted, held.items())
                        held = {}
                    held[lang] = np.zeros(BUCKETS, np.int64)
                at = trigrams(text)
                if len(at) < BUCKETS // 8:
                    np.add.at(held[lang], at, 1)
                else:
                    held[lang] += np.bincount(at, minlength=BUCKETS)
        yield from map(counted, held.items())

    def counted(of):
        lang, n = of
        at = np.append(-1, np.nonzero(n)[0])  # -1: the language itself, even if it has no letters
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(np.append(0, n[at[1:]]))], ["lang", "bucket", "n"])

    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    found = known.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    labels = found["lang"].to_pylist()
    languages = sorted(set(labels))
    place = {lang: i for i, lang in enumerate(languages)}
    counts = np.full((BUCKETS, len(languages)), ALPHA)
    bucket, own = found["bucket"].to_numpy(), np.array([place[x] for x in labels], np.int64)
    real = bucket >= 0
    counts[bucket[real], own[real]] += found["n"].to_numpy()[real]
    share = counts / counts.sum(axis=0)
    return Model(languages, np.log(np.hstack([share, (1 - UNSEEN_SHARE) * share + UNSEEN_SHARE / BUCKETS])).astype(np.float32))


def visible(page: str) -> str:
    return html.unescape(UNSEEN.sub(" ", page))


def vote(ll: np.ndarray) -> np.ndarray:
    """A text's posterior by language, times how far its entropy is below the greatest, and less for few trigrams (half at
    HALF_VOTE): doubtful and short texts hardly vote."""
    p = np.exp(TEMPER * (ll - ll.max()))
    p /= p.sum()
    n = -ll[-1] / np.log(BUCKETS)  # the last is the uniform model's
    return p[:-1] * (1 + (p * np.log(np.maximum(p, 1e-300))).sum() / np.log(len(p))) * n / (n + HALF_VOTE)


def scored(rows: DataFrame, text_col: str, model: Model, reader: Callable[[str], str] | None = None, drop_text: bool = False) -> DataFrame:
    """rows with __ll, log likelihoods by language and of none, and __soft, the text's vote; null without letters."""
    names = [c for c in rows.columns if not (drop_text and c == text_col)]
    kept = rows.select(*names, *([F.col(text_col)] if drop_text else []))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lls, softs = [], []
        for text in batch.column(text_col).to_pylist():
            ll = model.log_likelihoods(reader(text) if reader else text) if text else None
            if ll is None:
                lls.append(None)
                softs.append(None)
            else:
                lls.append(np.delete(ll, -2))
                softs.append(vote(ll[:-1]))
        kind = pa.list_(pa.float64())
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(lls, kind), pa.array(softs, kind)], [*names, "__ll", "__soft"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema.fields)
    return map_batches(kept, run, f"{schema}, __ll array<double>, __soft array<double>")


def primary(declared: Column) -> Column:
    return F.lower(F.regexp_extract(declared, "^([A-Za-z]{2,8})", 1))


def identified(rows: DataFrame, text_col: str, model: Model, declared: Column | None = None, suffix: Column | None = None, host: Column | None = None, reader: Callable[[str], str] | None = None, drop_text: bool = False) -> DataFrame:
    """rows with __language, __confidence and __text_language, the best by the text alone (null without letters)."""
    if not model.languages:
        return rows.withColumns({"__language": F.lit(UNKNOWN), "__confidence": F.lit(0.0), "__text_language": F.lit(None).cast("string")})
    many, text = range(len(model.languages)), F.lit("")
    keys = {"__declared": F.coalesce(primary(declared), text) if declared is not None else text, "__suffix": F.coalesce(suffix, text) if suffix is not None else text, "__host": F.coalesce(F.concat(F.lit("="), F.lower(host)), text) if host is not None else text}
    rows = rows.withColumns(keys)
    # Texts that go on with their rows are scored twice: that costs less than to write them once more.
    found = scored(rows, text_col, model, reader, drop_text)
    found = durable(found, "scored") if drop_text else found
    soft = (found if drop_text else scored(rows.select(*keys, text_col), text_col, model, reader, drop_text=True)).where("__soft is not null")
    sums = [F.sum(F.get("__soft", F.lit(i))).alias(f"s{i}") for i in many]
    again = [F.sum(f"s{i}").alias(f"s{i}") for i in many]
    base = durable(soft.groupBy("__declared", "__suffix", "__host").agg(*sums), "evidence")
    total = base.agg(*again).first()
    weight = np.array([total[i] or 0.0 for i in many]) + 1.0
    everywhere = F.array(*[F.lit(float(w)) for w in weight / weight.sum()])

    def smooth(array: Column, towards: Column) -> Column:
        size = F.aggregate(array, F.lit(0.0), lambda a, x: a + x) + SMOOTHING
        return F.zip_with(array, towards, lambda s, p: (s + SMOOTHING * p) / size)

    def summed(by: str) -> DataFrame:
        return base.groupBy(by).agg(*again).select(by, F.array(*[F.col(f"s{i}") for i in many]).alias(f"{by}_sum"))

    def odds(by: str) -> DataFrame:
        ratio = F.zip_with(smooth(F.col(f"{by}_sum"), everywhere), everywhere, lambda p, q: F.log(p / q))
        return durable(summed(by).where(F.col(by) != "").select(by, ratio.alias(f"{by}_odds")), "odds")

    hosts = summed("__host").withColumns({"__domain": F.substring_index("__host", ".", -2), "__top": F.substring_index("__host", ".", -1)})
    added = F.array(*[F.sum(F.get("__host_sum", F.lit(i))) for i in many])
    tops = hosts.groupBy("__top").agg(added.alias("__t")).select("__top", smooth(F.col("__t"), everywhere).alias("__tp"))
    domains = hosts.groupBy("__domain", "__top").agg(added.alias("__d")).join(tops, "__top").select("__domain", "__top", smooth(F.col("__d"), F.col("__tp")).alias("__dp"))
    priors = durable(hosts.join(domains, ["__domain", "__top"]).select("__host", "__host_sum", "__dp"), "priors")

    found = found.join(priors, "__host", "left").join(odds("__declared"), "__declared", "left").join(odds("__suffix"), "__suffix", "left")
    none = F.array(*[F.lit(0.0) for _ in many])
    others = F.zip_with(F.coalesce("__host_sum", none), F.coalesce("__soft", none), lambda a, b: F.greatest(a - b, F.lit(0.0)))
    score = F.zip_with(F.slice("__ll", 1, len(many)), smooth(others, F.coalesce("__dp", everywhere)), lambda ll, p: TEMPER * ll + F.log(p))
    for by in ("__declared", "__suffix"):
        score = F.zip_with(score, F.coalesce(f"{by}_odds", none), lambda a, b: a + b)
    score = F.concat(score, F.array(TEMPER * F.get("__ll", F.lit(len(many))) + float(np.log(UNKNOWN_PRIOR))))
    names = F.array(*[F.lit(x) for x in (*model.languages, UNKNOWN)])
    found = found.withColumn("__score", score)
    best = F.array_max(F.zip_with("__score", names, lambda s, n: F.struct(s.alias("s"), n.alias("n"))))
    by_text = F.array_max(F.zip_with(F.slice("__ll", 1, len(many)), names, lambda s, n: F.struct(s.alias("s"), n.alias("n"))))
    mass = F.aggregate(F.transform("__score", lambda s: F.exp(s - F.array_max("__score"))), F.lit(0.0), lambda a, x: a + x)
    out = [c for c in rows.columns if c not in keys and not (drop_text and c == text_col)]
    return found.select(*out, F.coalesce(best["n"], F.lit(UNKNOWN)).alias("__language"), F.coalesce(1 / mass, F.lit(0.0)).alias("__confidence"), F.when(F.col("__ll").isNotNull(), by_text["n"]).alias("__text_language"))


def page_languages(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, language, confidence, text_language, declared) of each page."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), F.regexp_extract(html_col, DECLARED, 1).alias("declared"))
    found = identified(rows.withColumns({"sfx": suffix_of("url"), "hst": host_of("url")}), "html", model, F.col("declared"), F.col("sfx"), F.col("hst"), visible, drop_text=True)
    return found.select("id", "url", F.col("__language").alias("language"), F.col("__confidence").alias("confidence"), F.col("__text_language").alias("text_language"), "declared")


def host_of(url: str) -> Column:
    return F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def suffix_of(url: str) -> Column:
    """The top domain and, where a path starts with a code of two letters, that."""
    return F.concat_ws("/", F.substring_index(host_of(url), ".", -1), F.lower(F.regexp_extract(url, "^[^:]+://[^/]+/([a-zA-Z]{2})(?:[/?#]|$)", 1)))


def known_languages(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang", host_col: str = "source", least: float = 0.5) -> DataFrame:
    """docs in one of the model's languages with a confidence of `least`; lang_col becomes that language."""
    found = identified(docs, text_col, model, F.col(lang_col), None, F.col(host_col))
    kept = found.where((F.col("__language") != UNKNOWN) & (F.col("__confidence") >= least))
    return kept.select(*[F.col("__language").alias(c) if c == lang_col else F.col(c) for c in docs.columns])
