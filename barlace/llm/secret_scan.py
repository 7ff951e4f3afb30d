"""Operator 8: secret scans by fixed patterns and a linear-chain conditional random field.

The patterns give the base spans.  The field tags tokens as secret begin (B),
inside (I) or outside (O).  Its features are the token's shape (``own_features``), the
words and marks beside it (``context_features``) and features of the whole text.  It is
trained here by gradient ascent on the log-likelihood of sentences that a rule makes,
with every secret of theirs labelled, of letters or of digits alone as well.  A span of
the field is added unless it meets a base span.

Viterbi runs over all tokens that can be labelled B or I at all: a token is *closed* if
its own weights, with the most favourable weights of every context feature and of both
transitions added, still prefer O; once for places near a cue word, and once for all
others.  Closed tokens are O; what is left falls into runs of neighbours that are decoded
one by one.  Which tokens are closed follows from the learned weights alone, and is looked
up once a token in a bounded cache.

Offsets count code points, ends are exclusive.

Cases: null text counts as empty; null ids are kept; repeated rows are judged
each; the empty digest list hashes the empty string; overlapping kinds are all
listed, by start and then by kind; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the base patterns.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that have 24 or more characters
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "crf")
CUES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key", b"akia")

TOKEN = re.compile(r"[\w+/=-]+(?:\.[\w+/=-]+)*|[^\s\w]")
LABELS = ("O", "B", "I")
#: Sentences that the field is trained on.
TRAIN_SENTENCES = 1600
TRAIN_STEPS = 120
#: Tokens whose own scores are kept before the cache starts anew.
CACHE_TOKENS = 300_000


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LEAST]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


@lru_cache(4096)
def _share(n: int, size: int) -> float:
    return n / size * math.log2(n / size)


def entropy(token: str) -> float:
    size = len(token)
    return -sum([_share(n, size) for n in Counter(token).values()])


def shape(token: str) -> str:
    """Character classes with runs folded: ``aB3-`` for lower, upper, digit, other."""
    kinds = ["9" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else "-" for c in token]
    return "".join(k for i, k in enumerate(kinds) if not i or kinds[i - 1] != k)


# Fixed words that announce a secret, and words that announce other values or prose; the field learns their weights.
CUE_WORDS = {
    "access", "apikey", "auth", "authorization", "bearer", "config", "credential", "credentials", "env", "export", "key", "keys", "login", "pass", "passphrase", "passwd", "password", "passwords",
    "pin", "private", "pwd", "secret", "secrets", "signature", "signing", "token", "tokens",
}
OTHER_WORDS = {
    "a", "account", "an", "and", "at", "build", "by", "call", "card", "code", "commit", "count", "date", "file", "for", "from", "id", "in", "invoice", "is", "isbn", "it", "mail", "model", "no", "number", "of", "on", "or",
    "order", "page", "part", "phone", "release", "room", "see", "tel", "that", "the", "ticket", "to", "use", "uses", "version", "was", "with",
}
#: How far before and behind a token a cue word counts as near.
BEFORE, BEHIND = 6, 3


def known(word: str) -> str:
    """A word of the lists in lower case; ``~`` stands for all others."""
    low = word.lower()
    return low if low in CUE_WORDS or low in OTHER_WORDS else "~"


def file_features(tokens: list[str]) -> list[str]:
    return [f"file:cue={any(t.lower() in CUE_WORDS for t in tokens)}"]


#: Class of each ASCII character, as ``shape`` writes it, and runs of one class.
_CLASSES = bytes(57 if 48 <= b <= 57 else 97 if 97 <= b <= 122 else 65 if 65 <= b <= 90 else 45 for b in range(256))
_RUNS = re.compile(rb"(.)\1+")
_HEX_TOKEN = re.compile("[0-9a-fA-F]+")


def own_facts(token: str) -> tuple:
    """What the features of a token by itself depend on; ASCII tokens are told by their bytes."""
    n = len(token)
    if ascii_only := token.isascii():
        codes = token.encode().translate(_CLASSES)
        digits, low, high = codes.count(b"9"), codes.count(b"a"), codes.count(b"A")
        letters = low + high
        folds = codes[:1].decode() if n in (digits, low, high) else _RUNS.sub(rb"\1", codes).decode()
        mixed = low > 0 and high > (codes[:1] == b"A")
    else:
        folds = shape(token)
        digits, letters = sum(c.isdigit() for c in token), sum(c.isalpha() for c in token)
        mixed = any(c.islower() for c in token) and any(c.isupper() for c in token[1:])
    kind = "letters" if letters == n else "digits" if digits == n else "both" if letters and digits else "other"
    symbol = "" if ascii_only and letters + digits == n else "".join(sorted({c for c in token if not c.isalnum()}))[:3]
    return (
        min(n // 3, 14), kind, min(int(entropy(token) * 2), 10), min(len(folds) // 2, 8), folds[:3], int(8 * digits / n), mixed, _HEX_TOKEN.fullmatch(token) is not None, symbol, ascii_only
    )


def named_facts(facts: tuple) -> list[str]:
    size, kind, bits, folds, start, digits, mixed, hexadecimal, symbol, ascii_only = facts
    return [
        "bias", f"length={size}", f"kind={kind}", f"kind={kind},length={size}", f"entropy={bits}", f"folds={folds}", f"start={start}",
        f"digits={digits}", f"mixed={mixed}", f"mixed={mixed},length={size}", f"hex={hexadecimal}", f"symbol={symbol}", f"ascii={ascii_only}",
    ]


def own_features(token: str) -> list[str]:
    return named_facts(own_facts(token))


#: Marks that the context tells apart.
MARKS = set(":=\"'@/,.;()<>")
#: Those of them that, like cue words, may announce a value.
SIGNS = set(":=\"'@/")
#: Feature groups of the context; a token has at most one of each.
CONTEXT = ("before", "before2", "after", "marks", "next", "file:cue")


def context_features(tokens: list[str], i: int, file: list[str]) -> list[str]:
    words = [t for t in tokens[max(0, i - BEFORE) : i] if t.isalpha()]
    after = next((known(t) for t in tokens[i + 1 : i + 1 + BEHIND] if t.isalpha()), "")
    marks = "".join(t for t in tokens[max(0, i - 2) : i] if not t.isalnum())
    follows = tokens[i + 1][:1] if i + 1 < len(tokens) and not tokens[i + 1].isalnum() else ""
    before = known(words[-1]) if words else ""
    return [
        f"before={before}", f"before2={known(words[-2]) if len(words) > 1 else ''}", f"after={after}", f"marks={marks[-2:] if set(marks[-2:]) <= MARKS else '~'}",
        f"next={follows if follows in MARKS else '~'}", *file
    ]


def runs(positions: list[int]) -> list[list[int]]:
    """Positions in runs of neighbours."""
    out: list[list[int]] = []
    for i in positions:
        if out and out[-1][-1] == i - 1:
            out[-1].append(i)
        else:
            out.append([i])
    return out


@dataclass
class Field:
    """Weights of a linear-chain field: label scores by feature, and transitions (row: before)."""

    weights: dict[str, np.ndarray]
    moves: np.ndarray

    def __post_init__(self):
        self.plain = {f: tuple(map(float, w)) for f, w in self.weights.items()}
        m = self.moves
        turn = max(m[p, x] + m[x, q] - m[p, 0] - (m[0, q] if q != 2 else m[0, 1]) for p in range(3) for x in (1, 2) for q in range(3) if not (p == 0 and x == 2))
        far, near = dict.fromkeys(CONTEXT, 0.0), dict.fromkeys(CONTEXT, 0.0)
        for f, (out, begin, inside) in self.plain.items():
            group, _, value = f.partition("=")
            if group in near:
                near[group] = max(near[group], begin - out, inside - out)
                if value not in CUE_WORDS and SIGNS.isdisjoint(value) and value != "True":
                    far[group] = max(far[group], begin - out, inside - out)
        #: Most that context and transitions can speak for B or I: away from cue words and signs, and near them.
        self.cue = near["file:cue"] - far["file:cue"]
        self.far, self.near = (sum(x.values()) + max(0.0, turn) for x in (far, near))
        self.cache: dict[str, tuple[int, str, tuple]] = {}
        self.sums: dict[tuple, tuple[float, float, float]] = {}

    def own(self, token: str) -> tuple[int, str, tuple]:
        """(2 if open everywhere, 1 if open near cue words and signs, 0 if closed; ``cue``, ``sign`` or nothing; scores by itself)."""
        try:
            return self.cache[token]
        except KeyError:
            if len(self.cache) >= CACHE_TOKENS:
                self.cache.clear()
                self.sums.clear()
            facts = own_facts(token)
            if (s := self.sums.get(facts)) is None:
                self.sums[facts] = s = self.total(named_facts(facts))
            lead = max(s[1], s[2]) - s[0]
            kind = "cue" if token.lower() in CUE_WORDS else "sign" if token in SIGNS else ""
            self.cache[token] = found = (2 if lead + self.far >= 0 else 1 if lead + self.near >= 0 else 0, kind, s)
            return found

    def open_tokens(self, tokens: list[str]) -> list[int]:
        """Positions that are not closed."""
        get, own = self.cache.get, self.own
        facts = [get(t) or own(t) for t in tokens]
        close: set[int] = set()
        cue = False
        for i, f in enumerate(facts):
            if f[1] == "cue":
                close.update(range(i - BEHIND, i + BEFORE + 1))
                cue = True
            elif f[1]:
                close.update((i - 1, i + 1, i + 2))
        if cue:  # the whole text then has the feature of a cue
            return [i for i, f in enumerate(facts) if f[0] == 2 or (f[0] == 1 and (i in close or f[2][1] - f[2][0] + self.far + self.cue >= 0 or f[2][2] - f[2][0] + self.far + self.cue >= 0))]
        return [i for i, f in enumerate(facts) if f[0] == 2 or (f[0] == 1 and i in close)]

    def total(self, features: list[str]) -> tuple[float, float, float]:
        found = [w for f in features if (w := self.plain.get(f))]
        return (sum(w[0] for w in found), sum(w[1] for w in found), sum(w[2] for w in found))

    def scores(self, tokens: list[str], run: list[int], file: list[str]) -> np.ndarray:
        """Scores of a run of tokens."""
        rows = []
        for i in run:
            own, context = self.own(tokens[i])[2], self.total(context_features(tokens, i, file))
            rows.append((own[0] + context[0], own[1] + context[1], own[2] + context[2]))
        return np.array(rows)

    def decode(self, scores: np.ndarray) -> list[int]:
        """Viterbi over a run; an outside token stands on either side of it."""
        best, back = self.moves[0] + scores[0], []
        for s in scores[1:]:
            options = best[:, None] + self.moves
            back.append(options.argmax(axis=0))
            best = options.max(axis=0) + s
        label = int((best + self.moves[:, 0]).argmax())
        labels = [label]
        for b in reversed(back):
            labels.append(label := int(b[label]))
        return labels[::-1]


FORBIDDEN = -1e4


def _start_moves() -> np.ndarray:
    moves = np.zeros((3, 3))
    moves[0, 2] = FORBIDDEN  # inside never follows outside
    return moves


def sentences(n: int, seed: int = 7):
    """Labelled token sequences made by a rule: (tokens, set of positions that begin, set that continue a secret)."""
    draw = random.Random(seed)
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    word = lambda: "".join(draw.choice(letters) for _ in range(draw.choice([1, 2, 3, 4, 4, 5, 6, 7, 8, 9, 11, 14, 16])))
    pick = lambda chars, k: "".join(draw.choice(chars) for _ in range(k))
    alnum, b64 = letters + letters.upper() + digits, letters + letters.upper() + digits + "+/"
    cues = ["key", "secret", "token", "password", "passwd", "bearer", "auth", "credential", "pwd", "private", "signature", "passphrase"]
    plain = ["order", "version", "build", "page", "release", "model", "invoice", "part", "ticket", "commit", "file", "room", "phone", "call"]
    phrase = lambda: "".join(pick(letters, draw.randint(3, 7)) for _ in range(draw.randint(4, 6)))
    for _ in range(n):
        kind = draw.randrange(12)
        lead = [word() for _ in range(draw.randint(0, 5))]
        mark = draw.choice([[], [":"], ["="], [":", '"'], ["=", "'"]])
        more: set[int] = set()
        if kind < 5:  # a value that tells by itself, with or without a cue
            body = draw.choice([
                pick(b64, draw.randint(24, 60)), pick(alnum, draw.randint(16, 48)), pick(letters, draw.randint(2, 4)) + draw.choice("_-") + pick(alnum, draw.randint(20, 40)),
                pick(letters, 4) + "-" + pick(digits, draw.randint(8, 13)) + "-" + pick(alnum, draw.randint(10, 26)), pick("0123456789abcdef", draw.choice([32, 40, 64])), pick(letters + letters.upper(), draw.randint(24, 44)),
            ])
            tokens, begin = [*lead, draw.choice([*cues, word()]), *mark, body], {len(lead) + 1 + len(mark)}
            if draw.random() < 0.15:
                tokens.append(pick(alnum, draw.randint(16, 40)))
                more = {len(tokens) - 1}
        elif kind < 7:  # a value that only its place makes a secret
            body = draw.choice([phrase(), pick(digits, draw.randint(10, 20)), pick(alnum, draw.randint(8, 14)), pick(letters.upper() + digits, draw.randint(8, 16))])
            if draw.random() < 0.3:
                head = [*lead, draw.choice([word(), "postgres", "mysql", "https"]), ":", "//" + word(), ":"]
                tokens, begin = [*head, pick(alnum, draw.randint(8, 16)), "@", word()], {len(head)}
            else:
                tokens, begin = [*lead, draw.choice(cues), *draw.choice([mark, ["is"]]), body], set()
                begin = {len(tokens) - 1}
        else:
            body = draw.choice([
                word() + pick(digits, draw.randint(2, 4)) + word(), f"{word()}-{word()}-{draw.randint(10, 2030)}", f"v{draw.randint(1, 9)}.{draw.randint(0, 20)}.{draw.randint(0, 99)}-{word()}",
                f"{word()}/{word()}/{word()}{draw.randint(1, 99)}.{draw.choice(['txt', 'html', 'png'])}", pick(letters.upper(), 2) + pick(digits, draw.randint(6, 14)),
                f"{draw.randint(1990, 2030)}-{draw.randint(10, 12)}-{draw.randint(10, 28)}T{draw.randint(10, 23)}", f"{word()}_{word()}_{draw.randint(1, 999)}", phrase(), pick(digits, draw.randint(4, 19)), word().capitalize() + word().capitalize(), f"{word()}.{draw.randint(1, 99)}", f"{word()}{draw.randint(1, 9)}.{word()}.com",
            ])
            if draw.random() < 0.5:  # a cue word in plain prose
                tokens = [*lead, draw.choice(cues), *draw.choice([[], [":"], ["is"], ["of"], ["was"]]), word(), word()]
            elif draw.random() < 0.2:  # words in capitals, letters by themselves
                tokens = [word().upper() if draw.random() < 0.8 else draw.choice(letters.upper()) for _ in range(draw.randint(2, 9))]
            elif draw.random() < 0.15:
                tokens = [*lead, f"{word()}.{draw.randint(1, 99)}", "@", f"{word()}{draw.randint(1, 9)}.{word()}.com"]
            else:
                tokens = [*lead, draw.choice([*plain, word()]), *draw.choice([[], mark]), body]
            begin = set()
        yield tokens + [word() for _ in range(draw.randint(0, 5))], begin, more


def _expected(scores: np.ndarray, rows: list[np.ndarray], moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(label marginals of all tokens, summed transition marginals); ``rows``: tokens at step i of all sentences that have one."""
    top = scores.max(axis=1, keepdims=True)
    local, turns = np.exp(scores - top), np.exp(moves)
    ahead, scale = np.empty_like(local), np.empty(len(local))
    for i, at in enumerate(rows):
        p = (ahead[at - 1] @ turns if i else turns[0]) * local[at]
        scale[at] = p.sum(axis=1)
        ahead[at] = p / scale[at, None]
    behind, pairs = np.empty_like(local), np.zeros((3, 3))
    last = np.ones(len(local), bool)
    for at in rows[1:]:
        last[at - 1] = False
    behind[last] = turns[:, 0]
    for at in rows[:0:-1]:
        back = local[at] * behind[at] / scale[at, None]
        behind[at - 1] = back @ turns.T
        mass = (ahead[at] * behind[at]).sum(axis=1, keepdims=True)
        pairs += (ahead[at - 1] / mass).T @ back * turns
    marginals = ahead * behind
    marginals /= marginals.sum(axis=1, keepdims=True)
    pairs[0] += marginals[rows[0]].sum(axis=0)
    pairs[:, 0] += marginals[last].sum(axis=0)
    return marginals, pairs


def train_field(n: int = TRAIN_SENTENCES, steps: int = TRAIN_STEPS, seed: int = 7, penalty: float = 0.05) -> Field:
    """Maximum likelihood with a quadratic penalty, by gradient ascent with per-weight steps, all sentences at once."""
    names: dict[str, int] = {}
    features, gold, lengths = [], [], []
    for tokens, begin, more in sentences(n, seed):
        file = file_features(tokens)
        features += [[names.setdefault(f, len(names)) for f in own_features(t) + context_features(tokens, i, file)] for i, t in enumerate(tokens)]
        gold += [1 if i in begin else 2 if i in more else 0 for i in range(len(tokens))]
        lengths.append(len(tokens))
    held, gold, lengths = np.array(features), np.array(gold), np.array(lengths)
    firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    rows = [firsts[lengths > i] + i for i in range(lengths.max())]
    truth = np.eye(3)[gold]
    wanted = np.zeros((3, 3))
    inner = np.concatenate(rows[1:])
    np.add.at(wanted, (gold[inner - 1], gold[inner]), 1)
    np.add.at(wanted, (np.zeros(len(firsts), int), gold[firsts]), 1)
    np.add.at(wanted, (gold[firsts + lengths - 1], np.zeros(len(firsts), int)), 1)
    w, moves = np.zeros((len(names), 3)), _start_moves()
    fixed, flat, width = moves < 0, held.ravel(), held.shape[1]
    sums_w, sums_m = np.full_like(w, 1e-8), np.full_like(moves, 1e-8)
    for _ in range(steps):
        marginals, pairs = _expected(w[held].sum(axis=1), rows, moves)
        gap = truth - marginals
        gw = np.stack([np.bincount(flat, np.repeat(gap[:, k], width), len(names)) for k in range(3)], axis=1) - penalty * w
        gm = np.where(fixed, 0, wanted - pairs - penalty * moves)
        sums_w += gw * gw
        sums_m += gm * gm
        w += 0.5 * gw / np.sqrt(sums_w)
        moves += 0.5 * gm / np.sqrt(sums_m)
    return Field({name: w[i] for name, i in names.items()}, moves)


def field_spans(text: str, field: Field) -> list[tuple[int, int, str]]:
    tokens = TOKEN.findall(text)
    open_tokens = field.open_tokens(tokens)
    if not open_tokens:
        return []
    file, spans = file_features(tokens), []
    places = None
    for run in runs(open_tokens):
        labels = field.decode(field.scores(tokens, run, file))
        if any(labels):
            places = places or [m.span() for m in TOKEN.finditer(text)]
            for i, label in zip(run, labels, strict=True):
                if label == 1:
                    spans.append([*places[i], "crf"])
                elif label == 2:
                    spans[-1][1] = places[i][1]
    return [tuple(s) for s in spans]


def all_spans(text: str, field: Field) -> tuple[list, list]:
    """(base spans, all spans), each by start, then kind."""
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    base = sorted(base_spans(text), key=order) if may_hold(text.encode("utf-8", "surrogatepass")) else []
    more = [s for s in field_spans(text, field) if all(s[1] <= b[0] or b[1] <= s[0] for b in base)]
    return base, sorted(base + more, key=order)


_HEX_BYTES = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdef", np.uint8))


def may_hold(text: bytes) -> bool:
    """False only for texts in which no base pattern can find anything."""
    codes = np.frombuffer(text, np.uint8)
    low = text.lower()
    if ((codes >= 48) & (codes <= 57)).any() or any(cue in low for cue in CUES):
        return True
    stops = np.flatnonzero(~_HEX_BYTES[codes])
    return len(codes) >= HEX_LEAST and int(np.diff(stops, prepend=-1, append=len(codes)).max()) > HEX_LEAST


def written(spans: list) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each row."""
    held = docs.sparkSession.sparkContext.broadcast(field or train_field())
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        field, nothing = held.value, hashlib.sha256(b"").hexdigest()
        for batch in batches:
            counts: list[list[int]] = [[], [], []]
            digests, spans = [], []
            for text in batch.column("text").to_pylist():
                base, every = all_spans(text, field) if text else ((), ())
                for column, kind in zip(counts, KINDS, strict=False):
                    column.append(sum(s[2] == kind for s in base))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest() if base else nothing)
                spans.append(written(every))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.mapInArrow(run, RESULT)
