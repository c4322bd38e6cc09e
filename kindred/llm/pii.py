"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

``base_spans`` finds what strict patterns find: per kind leftmost, non-overlapping matches of a
pattern, those that fail the kind's check dropped without a retry. Such matches often swallow a
neighbour: a card number right after a phone number is one run of digits too long for both.
``candidates`` is generous: it proposes every piece of text that could be of a kind, written with
its own boundaries, and obfuscated addresses as well.

Labelers, each of which votes for, against or not at all on a candidate:
``pattern`` (a strict match is the same span), ``check`` (Luhn, byte range, number of digits,
known top-level domain), ``gazetteer`` (issuer prefixes, calling codes, private or reserved
addresses, known providers), ``context`` (words before the candidate), ``edges`` (stands
alone or inside a longer token) and ``plainness`` (dates, counters and repeated digits).

Expectation-maximisation over the vote patterns (the two-class model of Dawid and Skene,
each kind with its own prior) estimates how reliable each labeler is and how likely each
pattern is personal data. Those posteriors train a logistic regression over votes, kind, length and
make-up, which is the final span classifier. Both are fitted on counts of patterns, of which
there are at most ``4 * 3**6`` and some hundred times as many with shapes, summed over all candidates of
all texts; nothing else reaches the driver. Candidates that it accepts are added where they
overlap no base span of their kind; base spans always stay.

Defined cases: a null text is empty; a text without personal data has no spans and the hash
of the empty string; rows without an id and repeated rows are each judged; with no candidates
at all the classifier accepts nothing; an empty table gives an empty result. Offsets are code
points, ends exclusive. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.words import column, narrowed
from kindred.session import cut

KINDS = ("email", "ip", "card", "phone")

# The strict patterns. A run of digits or of name characters is entered at
# its start only, which gives the same matches in linear time.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

# Generous patterns for candidates.
LOOSE_CARD = re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ .-][0-9]{4}){2,3}(?:[ .-][0-9]{1,3})?)(?![0-9])")
LOOSE_PHONE = re.compile(
    r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"
)
LOOSE_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])")
LOOSE_EMAIL = re.compile(
    r"[A-Za-z0-9._%+-]{1,64}\s?(?:\[at\]|\(at\)|\{at\})\s?[A-Za-z0-9-]{1,63}"
    r"(?:\s?(?:\.|\[dot\]|\(dot\)|\{dot\})\s?[A-Za-z0-9-]{1,63})+",
    re.IGNORECASE,
)
OBFUSCATED = re.compile(r"[\[({]at[\])}]", re.IGNORECASE)

# Gazetteers and context words.
TOP_LEVEL = frozenset("com org net edu gov info biz io co de fr es it nl uk us ca au jp cn in br ru eu".split())
PROVIDERS = frozenset("gmail yahoo hotmail outlook icloud proton gmx web aol mail".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36", "30", "38")
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "62", "81", "82", "86", "90", "91")
FOR = {
    "email": frozenset("mail email e-mail contact write address an a".split()),
    "ip": frozenset("ip host server address from client login".split()),
    "card": frozenset("card visa mastercard amex credit debit pay payment karte tarjeta carte".split()),
    "phone": frozenset("call phone tel telephone mobile cell fax contact telefon móvil ruf".split()),
}
AGAINST = frozenset("version isbn issn order invoice sha md5 commit build page chapter figure section doi serial sku part no token key password".split())

LABELERS = ("pattern", "check", "gazetteer", "context", "edges", "plainness")
EM_STEPS = 60
#: Posterior of the final classifier from which a candidate is added.
ACCEPT = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Strict matches, by kind and then start."""
    found = [("email", a, b) for a, b in _emails(text)]
    if not DIGIT.search(text):
        return found
    for m in IP.finditer(text) if "." in text else ():
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = _digits(m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_digits(m.group())) <= 15:
            found.append(("phone", m.start(), m.end()))
    return found


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Pieces that may be personal data, the strict matches among them, by kind and start."""
    found = set(base)
    if OBFUSCATED.search(text):
        found.update(("email", m.start(), m.end()) for m in LOOSE_EMAIL.finditer(text))
    if DIGIT.search(text):
        for kind, pattern in (("ip", LOOSE_IP), ("card", LOOSE_CARD), ("phone", LOOSE_PHONE)):
            found.update((kind, m.start(), m.end()) for m in pattern.finditer(text))
    return sorted(found, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def votes(text: str, span: tuple[str, int, int], strict: set[tuple[str, int, int]]) -> list[int]:
    """1 for, -1 against, 0 no vote, in the order of ``LABELERS``."""
    kind, start, end = span
    piece, digits = text[start:end], _digits(text[start:end])
    before = text[max(0, start - 40) : start].lower().split()[-3:]
    before = {w.strip(".,:;()[]\"'=") for w in before}
    out = [int(span in strict)]
    if kind == "email":
        parts = re.split(r"[^A-Za-z0-9-]+", piece)
        out.append(1 if parts[-1].lower() in TOP_LEVEL else -1)
        out.append(int(any(p.lower() in PROVIDERS for p in parts[1:])))
    elif kind == "ip":
        values = [int(p[-4:]) for p in piece.split(".")]
        out.append(1 if max(values) <= 255 else -1)
        out.append(-1 if values[0] in (0, 127) or len(set(values)) == 1 else int(values[0] < 224))
    elif kind == "card":
        out.append(1 if 13 <= len(digits) <= 19 and luhn(digits) else -1)
        out.append(1 if digits.startswith(ISSUERS) else -1)
    else:
        out.append(1 if 9 <= len(digits) <= 15 else -1)
        plus = piece.startswith("+")
        out.append(1 if plus and digits.startswith(CALLING) else 1 if "(" in piece else 0)
    out.append(1 if before & FOR[kind] else -1 if before & AGAINST else 0)
    left, right = text[start - 1 : start], text[end : end + 1]
    inside = left.isalnum() or right.isalnum() or left in ("=", "#", "_") and left != ""
    out.append(-1 if inside else 1)
    plain = len(set(digits)) <= 2 and kind != "email" or re.fullmatch(r"(?:19|20)[0-9]{2}[ .-][0-9]{2,4}[ .-]?[0-9]{2,4}", piece)
    out.append(-1 if plain else 0)
    return out


def shape(span: tuple[str, int, int], text: str) -> list[int]:
    """Length, share of digits and number of other characters, in steps."""
    piece = text[span[1] : span[2]]
    digits = len(_digits(piece))
    marks = sum(not c.isalnum() for c in piece)
    return [min(5, len(piece) // 4), 3 * digits // max(1, len(piece)), min(3, marks)]


def estimate(kinds: np.ndarray, vote: np.ndarray, n: np.ndarray, steps: int = EM_STEPS) -> np.ndarray:
    """Posterior that each vote pattern is personal data, by EM over its counts."""
    score = vote.sum(axis=1)
    post = np.clip(0.5 + 0.15 * score, 0.05, 0.95)
    for _ in range(steps):
        log_odds = np.zeros(len(n))
        for k in range(len(KINDS)):
            own = kinds == k
            mass = (n * own).sum()
            prior = ((n * own * post).sum() + 1) / (mass + 2)
            log_odds[own] += np.log(prior / (1 - prior))
        for j in range(vote.shape[1]):
            for value in (-1, 0, 1):
                cast = vote[:, j] == value
                yes = ((n * post * cast).sum() + 1) / ((n * post).sum() + 3)
                no = ((n * (1 - post) * cast).sum() + 1) / ((n * (1 - post)).sum() + 3)
                log_odds[cast] += np.log(yes / no)
        post = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
    return post


def features(kinds: np.ndarray, vote: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """Indicator columns: kind, each vote, and shape within its kind."""
    columns = [np.ones(len(kinds))]
    columns += [kinds == k for k in range(len(KINDS))]
    columns += [vote[:, j] == v for j in range(vote.shape[1]) for v in (-1, 1)]
    for j, most in enumerate((6, 4, 4)):
        columns += [(shapes[:, j] == s) & (kinds == k) for s in range(most) for k in range(len(KINDS))]
    return np.column_stack(columns).astype(np.float64)


def train(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression with soft labels, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (y - p)) - ridge * w
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def examined(docs: DataFrame) -> DataFrame:
    """Of every row ``doc_id``, ``base`` spans and ``found`` candidates with votes and shapes.

    Spans are flat arrays: 3 numbers for each base span (kind, start, end), 12 for each candidate.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base_out, found_out = [], []
            for text in column(batch, "text").to_pylist():
                text = text or ""
                base = base_spans(text)
                strict, flat = set(base), []
                for span in candidates(text, base):
                    flat += [KINDS.index(span[0]), span[1], span[2]]
                    flat += votes(text, span, strict) + shape(span, text)
                base_out.append([x for k, a, b in base for x in (KINDS.index(k), a, b)])
                found_out.append(flat)
            many = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(base_out, many), pa.array(found_out, many)],
                ["doc_id", "base", "found"],
            )

    return narrowed(docs).mapInArrow(work, "doc_id bigint, base array<int>, found array<int>")


WIDTH = 3 + len(LABELERS) + 3


def classifier(rows: DataFrame) -> np.ndarray:
    """Weights of the span classifier from all candidates of ``examined`` rows."""
    each = F.transform(
        F.sequence(F.lit(0), (F.size("found") / WIDTH).cast("int") - 1),
        lambda i: F.concat(
            F.slice("found", i * WIDTH + 1, 1), F.slice("found", i * WIDTH + 4, WIDTH - 3)
        ),
    )
    patterns = (
        rows.where(F.size("found") > 0)
        .select(F.explode(each).alias("p"))
        .groupBy("p")
        .agg(F.count(F.lit(1)).alias("n"))
        .toArrow()
    )
    if not patterns.num_rows:
        return np.zeros(0)
    table = np.array(patterns["p"].to_pylist())
    n = patterns["n"].to_numpy().astype(np.float64)
    order = np.lexsort(table.T)
    table, n = table[order], n[order]
    kinds, vote, shapes = table[:, 0], table[:, 1 : 1 + len(LABELERS)], table[:, 1 + len(LABELERS) :]
    return train(features(kinds, vote, shapes), estimate(kinds, vote, n), n)


def _text_of(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``base_spans`` and ``spans`` (with those added) of every row of ``docs``.

    Both are text: ``kind:start:end`` by kind as in ``KINDS``, then start, joined by commas.
    """
    rows = cut(examined(docs), "examined")
    weights = classifier(rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base_out, all_out = [], []
            for base, found in zip(column(batch, "base"), column(batch, "found")):
                own = [tuple(x) for x in np.reshape(base.as_py(), (-1, 3)).astype(int).tolist()]
                spans = list(own)
                table = np.array(found.as_py(), np.int64).reshape(-1, WIDTH)
                if len(table) > len(own):
                    x = features(table[:, 0], table[:, 3 : 3 + len(LABELERS)], table[:, -3:])
                    sure = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
                    # the surest first, then the longest
                    for i in np.lexsort((table[:, 1], table[:, 1] - table[:, 2], -sure)):
                        kind, a, b = (int(v) for v in table[i, :3])
                        if sure[i] >= ACCEPT and not any(k == kind and a < d and c < b for k, c, d in spans):
                            spans.append((kind, a, b))
                base_out.append(_text_of(own))
                all_out.append(_text_of(sorted(spans)))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(base_out, pa.string()), pa.array(all_out, pa.string())],
                ["doc_id", "base_spans", "spans"],
            )

    return rows.mapInArrow(work, "doc_id bigint, base_spans string, spans string")


