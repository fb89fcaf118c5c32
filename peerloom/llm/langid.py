"""Operator 7: language identification by Bayesian evidence fusion.

The posterior of a page's language multiplies four parts: the likelihood of
its text (byte trigrams, tempered as neighbouring trigrams are not
independent), what its declared markup language and its address suffix say, and
a host prior. What a declaration or a suffix is worth is learned from grouped sums
of the texts' own posteriors: how much more often a language stands beside it than
elsewhere, smoothed by what the code would mean (DECLARED, SUFFIX). Host priors
come from grouped sums of the posteriors without them, in three levels: a host is
smoothed by its registered domain, a domain by all pages. A page's own vote is
taken out of every sum first.

Languages are those of the labelled texts, whatever they are. Codes are brought to
their two-letter form where there is one.

Edge cases: null or empty html has no text and no declaration, so suffix and
prior decide; a null or odd url has no suffix and the empty host; a declared language
that no labelled text has says nothing; repeated rows vote each; texts and pages of any
length are read whole; without labelled texts every page has a null language; an empty
table gives no rows; extra columns are ignored. The trigram model is fitted on a bounded
sample of labelled texts (about MAX_FIT a language, by the hashes of their doc_ids) and
counts of unseen trigrams are smoothed.
"""

from __future__ import annotations

import html as entities
import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

BUCKETS = 1 << 16
MAX_FIT, TEMPER = 1000, 0.2
#: What a declared code or a country's suffix is taken to be worth before anything is counted, and for how many pages that counts.
DECLARED, SUFFIX, MARK_WEIGHT = 0.9, 0.7, 20.0
#: Pages that the level above counts for.
HOST_WEIGHT, DOMAIN_WEIGHT = 5.0, 20.0
#: A host with over a share of 1 / HOT of the pages is joined by broadcast: there are fewer than HOT of them.
HOT = 200
#: Address suffixes that speak for a language.
SUFFIXES = {
    "de": "de", "at": "de", "uk": "en", "us": "en", "au": "en", "ie": "en", "nz": "en", "es": "es", "mx": "es", "ar": "es", "cl": "es", "co": "es",
    "fr": "fr", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "jp": "ja", "cn": "zh", "tw": "zh", "kr": "ko", "se": "sv",
    "no": "no", "dk": "da", "fi": "fi", "cz": "cs", "gr": "el", "tr": "tr", "hu": "hu", "ro": "ro", "ua": "uk", "ir": "fa", "il": "he", "vn": "vi", "id": "id",
}
#: Three-letter codes of languages that have a two-letter one.
SHORT = {
    "eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "ita": "it", "por": "pt", "nld": "nl", "dut": "nl", "pol": "pl",
    "rus": "ru", "jpn": "ja", "zho": "zh", "chi": "zh", "kor": "ko", "swe": "sv", "nor": "no", "nob": "no", "dan": "da", "fin": "fi", "ces": "cs",
    "cze": "cs", "ell": "el", "gre": "el", "tur": "tr", "hun": "hu", "ron": "ro", "rum": "ro", "ukr": "uk", "fas": "fa", "per": "fa", "heb": "he",
    "vie": "vi", "ind": "id", "ara": "ar", "hin": "hi", "ben": "bn", "cat": "ca", "bul": "bg", "hrv": "hr", "srp": "sr", "slk": "sk", "slo": "sk",
}
#: Labels under which countries register names (as in co.uk).
SECOND = frozenset("ac co com edu gob gov go gouv id ltd me mil ne net nom or org plc sch web".split())
DROP = re.compile(r"(?is)<(script|style|nav)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>")
LANG = re.compile(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,8})")
HOST = re.compile(r"(?i)[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)")


def code_of(code) -> str | None:
    """The primary part of a language code, in two letters if it has such a form; None for none."""
    head = re.split(r"[-_]", (code or "").strip().lower())[0]
    return SHORT.get(head, head) or None


def text_of(html) -> str:
    return entities.unescape(DROP.sub(" ", html)) if html else ""


def domain_of(host: str) -> str:
    """The registered domain: two labels, or three where the second is one under which a country registers."""
    labels = host.split(".")
    deep = len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in SECOND
    return host if host.replace(".", "").isdigit() else ".".join(labels[-3 if deep else -2 :])


def trigrams(text: str):
    """Buckets of the byte trigrams of the lower-cased text with runs of white space as one space."""
    import numpy as np

    raw = np.frombuffer(" ".join(text.lower().split()).encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, dtype=np.int64)
    x = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    return ((x * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


@dataclass
class Model:
    """Languages in the order of their codes, and log P(trigram | language), languages by buckets."""

    langs: list[str]
    table: object


def train(docs: DataFrame, max_fit: int = MAX_FIT) -> Model:
    """From about ``max_fit`` labelled texts of each language."""
    import numpy as np

    known = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    found = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect() if code_of(r["lang"])}
    langs = sorted({code_of(x) for x in found})
    if not langs:
        return Model([], np.zeros((0, BUCKETS), dtype=np.float32))
    rate = F.create_map(*[F.lit(x) for lang, n in sorted(found.items()) for x in (lang, max(1, n // max_fit))])
    few = known.where(F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.element_at(rate, F.col("lang"))) == 0).select("lang", "text")

    def run(batches):
        import pandas as pd

        counts: dict = {}
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                counts[lang] = counts.get(lang, 0) + np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, c in counts.items():
            yield pd.DataFrame({"lang": [lang], "c": [c.astype("<i8").tobytes()]})

    def total(pdf):
        import pandas as pd

        return pd.DataFrame({"lang": [pdf["lang"].iat[0]], "c": [sum(np.frombuffer(x, dtype="<i8") for x in pdf["c"]).astype("<i8").tobytes()]})

    table = np.full((len(langs), BUCKETS), 0.5)
    for r in few.mapInPandas(run, "lang string, c binary").groupBy("lang").applyInPandas(total, "lang string, c binary").collect():
        if code_of(r["lang"]):
            table[langs.index(code_of(r["lang"]))] += np.frombuffer(r["c"], dtype="<i8")
    return Model(langs, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32))


def _evidence(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, host, domain, suffix, declared (as it stands), mark (the declared language, if it is known), and l0.. (log
    evidence of the text)."""
    import pyarrow as pa

    shared = pages.sparkSession.sparkContext.broadcast(model)
    names = ["page_id", "host", "domain", "suffix", "declared", "mark", *(f"l{i}" for i in range(len(model.langs)))]
    kind = lambda n: "long" if n == "page_id" else "double" if re.fullmatch(r"l\d+", n) else "string"
    arrow = pa.schema([(n, {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[kind(n)]) for n in names])

    def run(batches):
        import numpy as np

        table, langs = shared.value.table, set(shared.value.langs)
        for b in batches:
            out = []
            for i, url, html in zip(*(b.column(c).to_pylist() for c in range(3))):
                m = HOST.match(url or "")
                host = m[1].lower().rstrip(".") if m else ""
                last = host.split(".")[-1]
                t = trigrams(text_of(html))
                logs = TEMPER * table[:, t].sum(axis=1, dtype=np.float64) if len(t) else np.zeros(len(table))
                m = LANG.search(html or "")
                said = code_of(m[1]) if m else None
                out.append((i, host, domain_of(host), last if re.fullmatch("[a-z]{2,24}", last) and "." in host else None, said,
                            said if said in langs else None, *(logs - logs.max(initial=-math.inf)).tolist()))
            cols = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    ).mapInArrow(run, ", ".join(f"{n} {kind(n)}" for n in names))


def _softmax(cols):
    top = F.greatest(*cols) if len(cols) > 1 else cols[0]
    exps = [F.exp(c - top) for c in cols]
    return [e / _total(exps) for e in exps]


def _total(cols):
    return sum(cols[1:], cols[0])


def _columns(tag: str, n: int) -> list:
    return [F.col(f"{tag}{i}") for i in range(n)]


def _named(cols, tag: str) -> list:
    return [c.alias(f"{tag}{i}") for i, c in enumerate(cols)]


def _sums(df: DataFrame, keys: list[str], votes: str, tag: str, n: int) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(f"{votes}{i}").alias(f"{tag}{i}") for i in range(n)])


def _less(tag: str, votes: str, n: int) -> list:
    """The sums without the page's own vote."""
    return [F.greatest(a - b, F.lit(0.0)) for a, b in zip(_columns(tag, n), _columns(votes, n))]


def _marked(rows: DataFrame, key: str, langs: list[str], meaning: dict[str, str], trust: float) -> DataFrame:
    """``rows`` with the log evidence of the mark ``key`` added to e0..: the lift of each language beside the mark over all
    pages, by the votes p0.. and their sums w0.., smoothed by what the mark means."""
    n = len(langs)
    counts = _sums(rows.where(F.col(key).isNotNull()), [key], "p", "m", n).withColumnRenamed(key, "__pl_key")
    small = counts.limit(100_001).count() <= 100_000
    rows = rows.join(F.broadcast(counts) if small else counts, F.col(key) == F.col("__pl_key"), "left")
    own, all_ = _less("m", "p", n), _less("w", "p", n)
    beside, everywhere = _total(own), _total(all_)
    says = F.element_at(F.create_map(*[F.lit(x) for kv in meaning.items() for x in kv]), F.col(key)) if meaning else F.lit(None)
    known = says.isin(langs) if n > 1 else F.lit(False)
    out = []
    for lang, mine, total, e in zip(langs, own, all_, _columns("e", n)):
        lift = mine / F.greatest(total, F.lit(1e-9)) * everywhere
        prior = F.when(known, F.when(says == lang, trust * n).otherwise((1 - trust) * n / max(1, n - 1))).otherwise(1.0)
        value = F.log((lift + MARK_WEIGHT * prior) / (beside + MARK_WEIGHT))
        out.append(e + F.when(F.col("__pl_key").isNotNull(), value).otherwise(0.0))
    rest = [c for c in rows.columns if not re.fullmatch(r"__pl_key|[me]\d+", c)]
    return rows.select(*rest, *_named(out, "e"))


def identify(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, host, declared, lang, probability for every page."""
    langs, n = model.langs, len(model.langs)
    rows = durable(_evidence(pages, model))
    none = lambda kind: F.lit(None).cast(kind)
    if not n:
        return rows.select("page_id", "host", "declared", none("string").alias("lang"), none("double").alias("probability"))
    rows = rows.select("page_id", "host", "domain", "suffix", "declared", "mark", *_named(_columns("l", n), "e"), *_named(_softmax(_columns("l", n)), "p"))
    rows = rows.join(F.broadcast(_sums(rows, [], "p", "w", n)))  # one row
    rows = _marked(rows, "mark", langs, {x: x for x in langs}, DECLARED)
    rows = _marked(rows, "suffix", langs, SUFFIXES, SUFFIX)
    votes = durable(rows.select("page_id", "host", "domain", "declared", *_columns("e", n), *_named(_softmax(_columns("e", n)), "v")))
    sizes = votes.groupBy("host", "domain").agg(F.count(F.lit(1)).alias("pages"), *[F.sum(f"v{i}").alias(f"h{i}") for i in range(n)])
    domains = _sums(sizes, ["domain"], "h", "d", n)
    world = domains.agg(F.lit(1).alias("one"), *[F.sum(f"d{i}").alias(f"w{i}") for i in range(n)])  # one row
    total = votes.count()
    priors = sizes.join(domains, "domain").join(F.broadcast(world)).withColumnsRenamed({"host": "hh", "domain": "hd"})
    hot = F.broadcast(durable(priors.where(F.col("pages") * HOT > total)))
    same = (F.col("host") == F.col("hh")) & (F.col("domain") == F.col("hd"))
    cold = votes.join(F.broadcast(hot.select("hh", "hd")), same, "left_anti")
    all_ = votes.join(hot, same).unionByName(cold.join(priors.where(F.col("pages") * HOT <= total), same))

    def smooth(counts, above, weight):
        return [(c + weight * a) / (_total(counts) + weight) for c, a in zip(counts, above)]

    all_ = all_.select("*", *_named(smooth(_less("w", "v", n), [F.lit(1.0 / n)] * n, 1.0), "a"))
    all_ = all_.select("*", *_named(smooth(_less("d", "v", n), _columns("a", n), DOMAIN_WEIGHT), "b"))
    host = smooth(_less("h", "v", n), _columns("b", n), HOST_WEIGHT)
    post = all_.select("page_id", "host", "declared", *_named([e + F.log(c) for e, c in zip(_columns("e", n), host)], "s"))
    prob = post.select("page_id", "host", "declared", F.array(*_softmax(_columns("s", n))).alias("q"))
    best = F.array_max("q")
    return prob.select("page_id", "host", "declared",
                       F.element_at(F.array(*[F.lit(x) for x in langs]), F.array_position("q", best).cast("int")).alias("lang"),
                       best.alias("probability"))


def op7_query(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), train(docs))
