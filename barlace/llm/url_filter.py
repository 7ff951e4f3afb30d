"""Operator 2: URL filters by rules and logistic regression on hashed character n-grams.

Rules name a host and a path prefix.  A rule fits its host and all subdomains if
the URL's path starts with the rule's path; the longest fitting rule decides
(host length first, then path length, allow before block on a tie).  Where none
fits, a logistic regression on hashed character n-grams of host and path
decides.  It is trained on the driver from a small labelled URL table (bounded
by FIT_ROWS).

Each distinct host and each distinct path costs one look at its n-grams; a
worker caches hosts, so a hot host costs no more than any other.

Cases: a null URL, or one without ``://``, has an empty host and path and goes
to the method; null ids are kept; repeated rows are judged each; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled URLs that are used, at most.
FIT_ROWS = 20_000
BUCKETS = 1 << 15
GRAMS = (3, 4, 5)
EPOCHS, PENALTY = 200, 1e-4
LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    def __str__(self) -> str:
        return self.host + self.path


#: Production rules.
RULES = (
    UrlRule("com", "/en/", "block"),
    UrlRule("example.com", "/en/7", "allow"),
    UrlRule("net", "/de/", "allow"),
    UrlRule("example.net", "/de/8", "block"),
    UrlRule("org", "/es/", "block"),
)


def split_url(url: str | None) -> tuple[str, str]:
    """(host with A-Z lower-cased, path); both empty without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((k for k in map(tail.find, "?#") if k >= 0), default=len(tail))
    return rest[:end].translate(LOWER), tail[:stop]


def fitting_rule(host: str, path: str, rules: tuple[UrlRule, ...]) -> UrlRule | None:
    fits = (r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path))
    return max(fits, key=lambda r: (len(r.host), len(r.path), r.verdict == "allow"), default=None)


def gram_buckets(part: str, text: str) -> np.ndarray:
    """Buckets of the distinct character n-grams of a host or a path."""
    marked = f"^{text}$"
    grams = {marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)}
    return np.array(sorted({xxhash.xxh3_64_intdigest(f"{part}:{g}") % BUCKETS for g in grams}), np.int64)


def url_features(host: str, path: str) -> np.ndarray:
    return np.concatenate([gram_buckets("host", host), gram_buckets("path", path)])


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float

    def part_score(self, part: str, text: str) -> float:
        buckets = gram_buckets(part, text)
        return float(self.weights[buckets].sum()) / max(len(buckets), 1) ** 0.5


def train_urls(rows: list[tuple[str, int]], epochs: int = EPOCHS, penalty: float = PENALTY) -> UrlModel:
    """Logistic regression on (url, 1 to block, 0 to allow), by full gradients with per-weight steps."""
    sides = [[(p, gram_buckets(p, t)) for p, t in zip(("host", "path"), split_url(u), strict=True)] for u, _ in rows]
    owner = np.concatenate([np.full(len(b), k) for k, s in enumerate(sides) for _, b in s]) if rows else np.empty(0, int)
    bucket = np.concatenate([b for s in sides for _, b in s]) if rows else np.empty(0, int)
    value = np.concatenate([np.full(len(b), max(len(b), 1) ** -0.5) for s in sides for _, b in s]) if rows else np.empty(0)
    y = np.array([label for _, label in rows], float)
    w, bias = np.zeros(BUCKETS), 0.0
    squares, bias_squares = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(epochs if len(set(y)) == 2 else 0):
        z = np.bincount(owner, w[bucket] * value, len(y)) + bias
        error = y - 1 / (1 + np.exp(-z))
        g = np.bincount(bucket, error[owner] * value, BUCKETS) - penalty * len(y) * w
        squares += g * g
        bias_squares += error.sum() ** 2
        w += 0.3 * g / np.sqrt(squares)
        bias += 0.3 * error.sum() / bias_squares**0.5
    return UrlModel(w, bias)


# Fixed words of the labelled URL table.
BLOCK_WORDS = (
    "casino poker bet bets win jackpot slots lottery pills pharma viagra cheap discount replica spam farm clicks ads track tracker "
    "banner popup adult sex porn xxx cams escort dating free download crack warez torrent loan payday crypto miracle hack"
).split()
ALLOW_WORDS = (
    "news weather library museum school college science history garden kitchen travel city health sports music theatre journal review "
    "research review energy forum maps atlas photo paper village bank market street river mountain harbor bridge"
).split()
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


def labelled_urls(n: int = 3000, seed: int = 5) -> list[tuple[str, int]]:
    """The small labelled URL table, made by a rule: words joined to hosts, under mixed subdomains, endings and paths."""
    draw = random.Random(seed)
    made = lambda: "".join(draw.choice(SYLLABLES) for _ in range(draw.randint(2, 5)))
    rows = []
    for k in range(n):
        block = k % 3 == 0
        if block:
            words = [draw.choice(BLOCK_WORDS), draw.choice([*BLOCK_WORDS, "x", made()])]
            draw.shuffle(words)
            name = draw.choice(["-", "-", ""]).join(words)
        else:
            name = draw.choice([made(), made(), draw.choice(ALLOW_WORDS), draw.choice("-_")[:1].replace("_", "").join([draw.choice(ALLOW_WORDS), made()])])
        host = draw.choice(["", "", "www.", "blog.", "m.", "shop."]) + name + draw.choice([".example", ""]) + draw.choice([".com", ".net", ".org"])
        path = draw.choice(["", f"/{draw.choice(['en', 'de', 'fr', 'es'])}"]) + "/" + draw.choice([str(draw.randint(1, 999)), made(), made() + ".html"]) + draw.choice(["", "/"])
        if block and draw.random() < 0.1:
            path = f"/{draw.choice(BLOCK_WORDS)}-{draw.choice(BLOCK_WORDS)}" + path
        rows.append((f"{draw.choice(['http', 'https'])}://{host}{path}", int(block)))
    return rows


def judge_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, labelled: list[tuple[str, int]] | None = None, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each URL."""
    model = train_urls(list(itertools.islice(labelled if labelled is not None else labelled_urls(), FIT_ROWS)))
    held = pages.sparkSession.sparkContext.broadcast(model)
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))

    def run(batches):
        model, hosts = held.value, {}
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for url in batch.column("url").to_pylist():
                host, path = split_url(url)
                if len(hosts) > 100_000:
                    hosts.clear()
                if host not in hosts:
                    hosts[host] = model.part_score("host", host) + model.bias
                score = 1 / (1 + np.exp(-np.clip(hosts[host] + model.part_score("path", path), -500, 500)))
                rule = fitting_rule(host, path, rules)
                verdict = rule.verdict if rule else "block" if score >= threshold else "allow"
                for column, value in zip(columns, (host, path, str(rule) if rule else None, verdict, float(score)), strict=True):
                    column.append(value)
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["page_id", "host", "path", "rule", "verdict", "score"],
            )

    return pages.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, score double")
