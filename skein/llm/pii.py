"""Operator 1: personal data by weak supervision.

Base patterns give fixed spans. Besides, every candidate (base spans and looser shapes: secrets, local phone numbers and
spelt addresses, IBANs, national numbers, names behind a title) gets votes of four labelers: shape, validity (check
digits, ranges, entropy), gazetteers (words before it, first names) and context; each may abstain. Votes are counted over
all rows. Expectation-maximisation estimates for every kind its share of true candidates and every labeler's reliability
on true and on false ones, from the votes alone but for anchors: candidates whose check digits or ranges settle the matter.
A logistic classifier of spans is then trained on the candidates' features with the posteriors as soft labels, and its
positive candidates are added to the base spans.

The local part of an address that is spelt out is looked for up to 64 characters, which is as long as one may be (RFC 5321).

Defined results: a null or empty text has no spans; a null doc_id stays null; repeated rows give a row each; an empty
table gives an empty one; other columns are not looked at, so their names cannot clash. Texts are searched whole, in time
linear in their length. Spans are code points, end exclusive; spans of two kinds may overlap, and stand by kind, then start.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import arrow_map, doc_texts, small_batches, staged

#: Kinds in the order of the digest; those behind the first four come from the method alone.
KINDS = ("email", "ip", "card", "phone", "secret", "contact", "iban", "national", "name")
N_BASE = 4
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is tried from its start only: from within, the same rest would follow
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Looser shapes that only the method may add.
SECRET = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{16,}={0,2}(?![A-Za-z0-9_+/=-])")
LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])")
SPELT_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?: ?\[at\] ?| ?\(at\) ?)[A-Za-z0-9-]{1,64}(?:(?: ?\[dot\] ?| ?\(dot\) ?|\.)[A-Za-z0-9-]{1,64})+")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
NATIONAL = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Sra", "Monsieur", "Madame", "Señor", "Señora")
NAME = re.compile(rf"(?<!\w)(?:{'|'.join(TITLES)})\.? ([^\W\d_a-z]\w+(?: [^\W\d_a-z]\w+){{0,2}})")
DIGIT = re.compile("[0-9]")
LOOSE = ((4, SECRET), (5, LOCAL_PHONE), (5, SPELT_EMAIL), (6, IBAN), (7, NATIONAL), (8, NAME))
WITH_DIGITS = (SECRET, LOCAL_PHONE, IBAN, NATIONAL)
#: Gazetteers: words that stand before personal data, by kind; words that stand before what only looks like it; first names.
CUES = (
    ("mail", "contact", "write to", "courriel", "correo"),
    ("ip", "host", "server", "addr"),
    ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    ("phone", "tel", "call", "fax", "mobile"),
    ("token", "secret", "key", "passw", "pwd", "credential", "bearer", "auth"),
    ("mail", "contact", "write to", "phone", "tel", "call", "fax"),
    ("iban", "account", "konto", "compte", "cuenta", "bank"),
    ("ssn", "social security", "national id", "tax id"),
    ("contact", "dear", "regards", "by ", "from "),
)
AGAINST = ("version", "isbn", "issn", "order no", "part no", "sku", "build", "commit", "sha1", "sha256", "checksum", "md5", "release")
FIRST_NAMES = frozenset((
    "ahmed", "alice", "anna", "carlos", "claire", "david", "elena", "emma", "fatima", "hans", "ivan", "james", "jan", "jean", "john", "jose", "julia", "karl", "laura", "li", "lucas",
    "maria", "marie", "mark", "martin", "michael", "mohamed", "olga", "paul", "peter", "pierre", "robert", "sara", "sarah", "sofia", "thomas", "wei", "william",
))
LABELERS = ("shape", "validity", "gazetteer", "context")
#: Distinct (kind, votes, features) tuples there can be: votes of 3 values, 4 sizes, 4 shares of digits, 2 flags.
TUPLES = 3 ** len(LABELERS) * 4 * 4 * 2
MAX_TUPLES = len(KINDS) * TUPLES


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the fixed patterns, leftmost and non-overlapping within a kind; every pattern is linear."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            done = at + 1
            at = text.find("@", at + 1)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip('0') or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() > 15:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdecimal() for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in (s.count(x) for x in set(s)))


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, key): base spans and looser shapes that overlap none of them; the key packs votes and features."""
    out = [(k, s, e, _key(text, k, s, e, False)) for k, s, e in base]
    shapes = [(k, x) for k, x in LOOSE if x in WITH_DIGITS] if DIGIT.search(text) else []
    if "(at)" in text or "[at]" in text:
        shapes.append((5, SPELT_EMAIL))
    if any(t in text for t in TITLES):
        shapes.append((8, NAME))
    taken = sorted((s, e) for _, s, e in base)
    for kind, shape in shapes:
        for m in shape.finditer(text):
            s, e = m.span()
            if shape is SECRET and not (any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])):
                continue
            if shape is NAME:
                s = m.start(1)
            if not any(a < e and s < b for a, b in taken):
                out.append((kind, s, e, _key(text, kind, s, e, True)))
    return out


def _shape(kind: int, span: str) -> int:
    if kind == 4:  # letters and digits mixed throughout, not words with a number
        turns = sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:], strict=False))
        return 1 if turns >= len(span) / 8 else -1 if turns <= 2 else 0
    return 0 if kind == 8 else 1


def _valid(kind: int, span: str) -> int:
    if kind == 0:
        local, _, domain = span.rpartition("@")
        return 1 if domain.rpartition(".")[2].isalpha() and not local.startswith(".") and not local.endswith(".") else -1
    if kind == 1:  # 1.2.3.4 may be a version
        return 1 if any(int(p) > 9 for p in span.split(".")) else 0
    if kind == 2:
        return 1 if len(set(span) - {" ", "-"}) > 1 else -1
    if kind == 3:
        return 1 if span[1] != "0" else -1
    if kind == 4:
        found, digits = _entropy(span), sum(c.isdecimal() for c in span) / len(span)
        return 1 if found >= 3.0 and digits >= 0.15 else -1 if found < 2.5 or digits < 0.08 else 0
    if kind == 5:
        digits = [c for c in span if c.isdecimal()]
        return (1 if digits[0] not in "01" else -1) if len(digits) == 10 else 0
    if kind == 6:
        return 1 if mod97(span.replace(" ", "")) else -1
    if kind == 7:
        return 1 if span[:3] not in ("000", "666") and span[0] != "9" and span[4:6] != "00" and span[7:] != "0000" else -1
    return 0


def _key(text: str, kind: int, start: int, end: int, loose: bool) -> int:
    span, before, after = text[start:end], text[max(0, start - 32) : start].lower(), text[end : end + 1]
    gazetteer = 1 if any(c in before for c in CUES[kind]) or kind == 8 and span.split()[0].lower() in FIRST_NAMES else -1 if any(c in before for c in AGAINST) else 0
    near = before.rstrip()[-1:]
    context = 1 if near and near in "=:\"'" or after and after in "\"'" else -1 if after.isalnum() or before[-1:].isalnum() else 0
    votes = (((_shape(kind, span) + 1) * 3 + _valid(kind, span) + 1) * 3 + gazetteer + 1) * 3 + context + 1
    digits = sum(c.isdecimal() for c in span) / len(span)
    return (((kind * 3 ** len(LABELERS) + votes) * 4 + min(3, len(span) // 12)) * 4 + min(3, int(digits * 4))) * 2 + loose


def kind_of(key: int) -> int:
    return key // TUPLES


def votes_of(key: int) -> list[int]:
    v = key // 32
    return [v // 3 ** (len(LABELERS) - 1 - j) % 3 - 1 for j in range(len(LABELERS))]


def anchor(key: int) -> float | None:
    """The truth of a candidate that check digits or ranges settle, if they do: cards, IBANs and addresses of hosts."""
    kind, valid = kind_of(key), votes_of(key)[1]
    if kind in (1, 2, 6) and valid == 1:
        return 0.99
    return 0.01 if kind in (6, 7) and valid == -1 else None


#: Of 100 rows' worth of votes of a kind, how many the prior of a labeler counts as, and the reliability it speaks for.
PRIOR_ROWS, PRIOR_SHARE = 10.0, 0.8


def estimate(counts: dict[int, int], rounds: int = 50) -> dict[int, float]:
    """Posterior of each key by EM, for each kind on its own.

    A labeler that votes is right on true candidates with one probability and on false ones with another, both estimated;
    one that abstains says nothing. Counts are taken as shares, so the result does not depend on the size of the input.
    """
    out: dict[int, float] = {}
    for kind in sorted({kind_of(k) for k in counts}):
        keys = sorted(k for k in counts if kind_of(k) == kind)
        votes = np.array([votes_of(k) for k in keys])
        weight = np.array([counts[k] for k in keys], float)
        weight *= 100 / weight.sum()
        known = np.array([np.nan if (a := anchor(k)) is None else a for k in keys])
        p = np.where(np.isnan(known), 1 / (1 + np.exp(-1.5 * votes.sum(1))), known)
        for _ in range(rounds):
            prior = ((weight * p).sum() + 1) / (weight.sum() + 2)
            log = np.full(len(keys), math.log(prior / (1 - prior)))
            for j in range(len(LABELERS)):
                v = votes[:, j]
                right = [((weight * q)[v == x].sum() + PRIOR_ROWS * PRIOR_SHARE) / ((weight * q)[v != 0].sum() + PRIOR_ROWS) for q, x in ((p, 1), (1 - p, -1))]
                log += np.where(v == 1, math.log(right[0] / (1 - right[1])), np.where(v == -1, math.log((1 - right[0]) / right[1]), 0.0))
            p = np.where(np.isnan(known), 1 / (1 + np.exp(-np.clip(log, -30, 30))), known)
        out.update(zip(keys, p.tolist(), strict=True))
    return out


def _features(keys: list[int]) -> np.ndarray:
    """Kind, votes, votes by kind, length, share of digits, looseness, and one."""
    kinds, n = len(KINDS), len(LABELERS)
    x = np.zeros((len(keys), kinds + 3 * n + 2 * kinds * n + 4 + 4 + 2))
    for row, k in zip(x, keys, strict=True):
        kind = kind_of(k)
        row[kind] = 1
        for j, v in enumerate(votes_of(k)):
            row[kinds + 3 * j + v + 1] = 1
            if v:
                row[kinds + 3 * n + 2 * (kind * n + j) + (v > 0)] = 1
        rest = kinds + 3 * n + 2 * kinds * n
        row[rest + k // 8 % 4] = row[rest + 4 + k // 2 % 4] = 1
        row[-1], row[-2] = 1, k % 2
    return x


def classify(counts: dict[int, int], posterior: dict[int, float], steps: int = 600) -> list[int]:
    """The keys that the span classifier, trained on the posteriors, takes for personal data. Each kind weighs the same."""
    if not counts:
        return []
    keys = sorted(counts)
    x, y = _features(keys), np.array([posterior[k] for k in keys])
    total: dict[int, int] = {}
    for k in keys:
        total[kind_of(k)] = total.get(kind_of(k), 0) + counts[k]
    weight = np.array([counts[k] / total[kind_of(k)] for k in keys], float)
    weight /= weight.sum()
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 4.0 * (x.T @ (weight * (p - y)) + 1e-5 * w)
    return [k for k, z in zip(keys, x @ w, strict=True) if z >= 0]


SPANS = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("kind", "start", "end", "key")]))
FOUND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("found", SPANS)])


def find(docs: DataFrame) -> DataFrame:
    """doc_id and found: every candidate with its key, one pass over the texts."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            found = []
            for text in b["text"]:
                found.append([dict(zip(("kind", "start", "end", "key"), c, strict=True)) for c in candidates(text, base_spans(text))])
            yield {"doc_id": b["doc_id"], "found": found}

    return arrow_map(docs, rows, FOUND)


def vote_counts(found: DataFrame) -> dict[int, int]:
    """How often each key stands in all rows: at most MAX_TUPLES of them."""
    return {r["key"]: r["count"] for r in found.select(F.explode("found.key").alias("key")).groupBy("key").count().collect()}


def accepted(found: DataFrame) -> list[int]:
    """Counts of keys over all rows, EM, and the classifier's choice."""
    counts = vote_counts(found)
    return classify(counts, estimate(counts))


def _good(found, keys: list[int]):
    take = F.array(*[F.lit(k) for k in keys]) if keys else F.array().cast("array<int>")
    return F.filter(found, lambda c: (c["kind"] < N_BASE) | F.array_contains(take, c["key"]))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array of (kind, start, end), base spans and accepted candidates, by kind and start."""
    small_batches(docs.sparkSession)
    found = staged(find(doc_texts(docs)), "pii")
    good = _good("found", accepted(found))
    return found.select("doc_id", F.array_sort(F.transform(good, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))).alias("spans"))


def _joined(c):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"] < N_BASE)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return spans(docs).select("doc_id", *[count(k) for k in range(N_BASE)], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with each stretch of overlapping spans replaced by the kind of its first one, in brackets."""
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in found):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced in text and n_chars renewed; all other columns as they are.

    The texts are searched once: documents are written with their candidates, so repeated and null ids need no care.
    A null text stays null, with its n_chars.
    """
    small_batches(docs.sparkSession)
    names = docs.columns
    row = docs.select(F.struct(*[docs[c] for c in names]).alias("row"))
    schema = T.StructType([row.schema["row"], T.StructField("found", SPANS)])

    def search(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            found = []
            for r in b["row"]:
                t = r["text"] or ""
                found.append([dict(zip(("kind", "start", "end", "key"), c, strict=True)) for c in candidates(t, base_spans(t))])
            yield b | {"found": found}

    known = staged(arrow_map(row, search, schema), "pii")
    good = _good("found", accepted(known))
    return arrow_map(known.select(F.col("row"), good.alias("found")), _replace(names), docs.schema)


def _replace(names: list[str]):
    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {n: [] for n in names}
            for r, found in zip(b["row"], b["found"], strict=True):
                if found and r["text"] is not None:
                    r["text"] = redact(r["text"], [(c["kind"], c["start"], c["end"]) for c in found])
                    if "n_chars" in r:
                        r["n_chars"] = len(r["text"])
                elif r["text"] is not None and "n_chars" in r:
                    r["n_chars"] = len(r["text"])
                for n in names:
                    out[n].append(r[n])
            yield out

    return rows


def text_sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()
