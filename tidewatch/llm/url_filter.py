"""URL filter: host and path rules first, then a ratio of character language models.

Rules are (host, path) pairs: a rule fits its host and all its subdomains where the URL's path starts with the rule's; the longest fit
(host and path together) wins. URLs that a rule decides are the accepted and rejected examples of two character models; all others
are judged by the models.

Models: smoothed variable-order Markov models of order ORDER over the URL's bytes behind "://" (A-Z lower-cased, digits all 0),
query and fragment included. p of order k interpolates the counts of the last k bytes with order k - 1 (Witten-Bell: the weight of the
lower order is the number of different bytes seen behind the context), down to a uniform one. Contexts of up to two bytes are told apart
exactly, those of three and four by one of SLOTS hashed slots for each order, which is about as many as URLs have; each byte behind a
slot has its own exact count. All URLs that rules decide are counted, by Spark; a model holds what occurs, sorted, and is bounded by
the slots and the bytes that URLs use.

Score: (log p_accepted - log p_rejected) / bytes. The threshold is calibrated on the decided URLs: of those whose crc32(url) mod 5 is
0, all of them, which the calibrating models do not count, it is the score with the best balanced accuracy on a fixed grid; the
final models count all.

A null URL, one without "://" or one with nothing behind it has empty host and path, no rule and score 0, and is allowed. Where either
class is missing, every score is 0 and all URLs without a rule are allowed. Repeated rows are judged alike (and count each time), long
URLs are read to the end, an empty table gives no rows. Other columns stay as they are; on a clash of names those made here win.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import mixed, packed, wider

ORDER, SLOTS = 4, 1 << 20
#: Verdict, host and path of each rule.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url) -> tuple["F.Column", "F.Column"]:
    """Behind the first ://, up to / ? # or the end, A-Z lower-cased; and from there up to ? # or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(u, instr(u, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages with host, path, rule and decided (the rule's verdict); rule and decided are null where none fits."""
    p = pages.drop("host", "path", "rule", "decided").withColumn("u", F.col("url").cast("string"))
    host, path = host_and_path(F.col("u"))
    p = p.withColumns({"host": host, "path": path})
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    rule = verdict = None
    for kind, h, start in ordered:
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(start)
        rule = F.when(fits, h + start) if rule is None else rule.when(fits, h + start)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return p.withColumns({"rule": none if rule is None else rule, "decided": none if verdict is None else verdict}).drop("u")


def cleaned(url: str | None) -> bytes:
    rest = (url or "").partition("://")[2].encode()
    return rest.translate(bytes(48 if 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else b for b in range(256)))


def keys_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each order 0..ORDER and byte of all texts one number for order, context and byte (context: without its last eight bits); and each text's size."""
    padded = np.frombuffer(b"".join(b"\x00" * ORDER + t for t in texts), dtype=np.uint8).astype(np.uint64)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    at = np.arange(int(sizes.sum())) + np.repeat(np.arange(1, len(texts) + 1) * ORDER, sizes)
    out = np.empty((ORDER + 1, len(at)), dtype=np.uint64)
    context = np.zeros(len(at), dtype=np.uint64)
    for k in range(ORDER + 1):
        if k:
            context = context << np.uint64(8) | padded[at - k]
        slot = context if k < 3 else mixed(context + np.uint64(k)) % np.uint64(SLOTS)
        out[k] = (np.uint64(k * SLOTS) + slot) << np.uint64(8) | padded[at]
    return out, sizes


def found(values: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The counts of values among sorted keys; 0 for those that are not there."""
    if not len(keys):
        return np.zeros(values.shape)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[at] == values, counts[at], 0).astype(np.float64)


class Model:
    """Counts of contexts with a byte, of contexts, and of different bytes behind contexts, for one class of URLs."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        """From keys, which may repeat, and their counts."""
        self.pairs, place = np.unique(np.asarray(keys, dtype=np.uint64), return_inverse=True)
        self.n = np.bincount(place, weights=counts, minlength=len(self.pairs))
        self.contexts, place, self.kinds = np.unique(self.pairs >> np.uint64(8), return_inverse=True, return_counts=True)
        self.sums = np.bincount(place, weights=self.n, minlength=len(self.contexts))

    def log_p(self, keys: np.ndarray) -> np.ndarray:
        """The logarithm of each byte's probability."""
        p = np.full(keys.shape[1], 1 / 256)
        for k in range(ORDER + 1):
            contexts = keys[k] >> np.uint64(8)
            kinds, sums = found(contexts, self.contexts, self.kinds), found(contexts, self.contexts, self.sums)
            p = np.where(kinds > 0, (found(keys[k], self.pairs, self.n) + kinds * p) / np.maximum(sums + kinds, 1), p)
        return np.log(p)


def counted(decided: DataFrame) -> dict[tuple[str, str], Model]:
    """Models by verdict for "rest" (URLs that do not calibrate) and "all", from url, decided and fold."""

    def count(batches):
        """Sums of this task."""
        held: dict[tuple[str, bool], list] = {}
        for batch in batches:
            kinds, apart = np.array(batch.column("decided").to_pylist()), np.array(batch.column("fold").to_pylist()) == 0
            texts = [cleaned(u) for u in batch.column("url").to_pylist()]
            for kind in ("allow", "block"):
                for out in (False, True):
                    some = [texts[i] for i in np.flatnonzero((kinds == kind) & (apart == out))]
                    if some:
                        keys, n = np.unique(keys_of(some)[0], return_counts=True)
                        parts = held.setdefault((kind, out), [])
                        parts.append((keys, n))
                        if len(parts) > 64:
                            parts[:] = [summed(parts)]
        for (kind, out), parts in held.items():
            keys, n = summed(parts)
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(keys)), pa.array([out] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)], names=["kind", "apart", "key", "n"])

    sums = decided.mapInArrow(count, "kind string, apart boolean, key long, n long").groupBy("kind", "apart", "key").agg(F.sum("n").alias("n"))
    got = sums.toPandas()  # twice a model's size at most, for each class
    models = {}
    for kind in ("allow", "block"):
        own = got[got.kind == kind]
        for name, rows in (("rest", own[~own.apart.astype(bool)]), ("all", own)):
            models[kind, name] = Model(rows.key.to_numpy(dtype=np.int64).view(np.uint64), rows.n.to_numpy(dtype=np.float64))
    return models


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(place, weights=np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)


def scores(urls: list[str | None], good: Model, bad: Model) -> tuple[np.ndarray, np.ndarray]:
    """Each URL's score, and whether there is anything to score."""
    keys, sizes = keys_of([cleaned(u) for u in urls])
    full, out = sizes > 0, np.zeros(len(urls))
    if full.any():
        out[full] = np.add.reduceat(good.log_p(keys) - bad.log_p(keys), (np.cumsum(sizes) - sizes)[full]) / sizes[full]
    return out, full


#: Scores are calibrated on a grid of this step, within these bounds.
STEP, BOUND = 1 / 256, 16


def balanced_cut(counts: dict[tuple[str, int], int]) -> float:
    """From counts by (verdict, grid place), the threshold with the best balanced accuracy; of equals, the one that blocks least."""
    places = range(int(-BOUND / STEP), int(BOUND / STEP) + 1)
    good, bad = (np.array([counts.get((kind, k), 0) for k in places], dtype=float) for kind in ("allow", "block"))
    if not good.sum() or not bad.sum():
        return 0.0
    value = np.cumsum(bad) / bad.sum() - np.cumsum(good) / good.sum()
    return (places[int(np.argmax(value))] + 1) * STEP


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages with host, path, rule, score and verdict."""
    made = ("host", "path", "rule", "score", "verdict")
    p = ruled(pages.select(packed(pages, "url", *made).alias("own"), F.col("url").cast("string").alias("url")), rules)
    decided = p.where("decided is not null").select("url", "decided", (F.crc32("url") % 5).alias("fold"))
    models = counted(decided)
    both = bool(len(models["allow", "all"].pairs) and len(models["block", "all"].pairs))
    shipped = pages.sparkSession.sparkContext.broadcast(models)

    def graded(batches):
        for batch in batches:
            s, _ = scores(batch.column("url").to_pylist(), shipped.value["allow", "rest"], shipped.value["block", "rest"])
            place = np.floor(np.clip(s, -BOUND, BOUND) / STEP).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("decided"), pa.array(place)], names=["decided", "place"])

    cut = 0.0
    if both:
        grid = decided.where("fold = 0").select("url", "decided").mapInArrow(graded, "decided string, place int").groupBy("decided", "place").count().collect()
        cut = balanced_cut({(r["decided"], r["place"]): r["count"] for r in grid})

    def scored(batches):
        for batch in batches:
            urls, decided = batch.column("url").to_pylist(), batch.column("decided").to_pylist()
            s, full = scores(urls, shipped.value["allow", "all"], shipped.value["block", "all"]) if both else (np.zeros(len(urls)), np.zeros(len(urls), dtype=bool))
            verdict = [d or ("allow" if v >= cut or not f else "block") for d, v, f in zip(decided, s.tolist(), full.tolist(), strict=True)]
            kept = batch.drop_columns(["decided"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(s), pa.array(verdict, pa.string())], names=[*kept.schema.names, "score", "verdict"])

    out = p.mapInArrow(scored, wider(p.drop("decided").schema, "score double, verdict string"))
    return out.select(*(F.col("url") if c.lower() == "url" else F.col("own").getField(c).alias(c) for c in pages.columns if c.lower() not in made), *made)
