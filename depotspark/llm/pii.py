"""Personal data: fixed base patterns, and a semi-Markov conditional random field that adds spans.

The base finds e-mail addresses, IP addresses, card and phone numbers by patterns and checks. The model reads the
text around digits and "@" as tokens; candidate segments of up to `MAX_TOKENS` tokens are scored by features of the
whole span (its shape, lengths, separators, checks, and the word before), and dynamic programming over segments of
bounded length chooses boundaries and types together. Stretches without any candidate take the label "none", so a
text splits into independent pieces and the whole of it is covered. Spans of the model that overlap no base span are
added; base spans always stay.

The model is trained here, once a process, on generated sentences with a fixed seed (`TRAIN_SENTENCES`, a documented
bound): entities in base and in loose forms (national numbers, "name [at] host [dot] com", dotted or dashed cards),
secrets (a kind of the model's own: tokens, keys, passwords), and look-alikes (dates, versions, decimals, order numbers,
checksums, failing checks). Only its weights are sent to the tasks. An entity has `MAX_TOKENS` tokens at most, and the
model reads `REACH` characters around a digit or at-sign, more than the longest legal mail address.

Defined cases: null text is empty; empty text has no spans; very long texts are read whole, in linear time; repeated
rows give repeated results; other columns pass through `find` untouched except those it makes.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from depotspark.llm.common import table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
MAX_TOKENS = 32
REACH = 254
TRAIN_SENTENCES = 1200

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is entered at its start only: later starts in it match no more
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if re.search("[0-9]", text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() and c.isascii() for c in m[0]) <= 15]
    return out


# ---- the semi-Markov model -------------------------------------------------------------------------------------

_TOKEN = re.compile(r"(?<![A-Za-z0-9])(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{16,}|[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]|\s+")
#: Words that can stand before an entity or inside one.
_CUES = {
    "mail": "email", "email": "email", "e": "email", "contact": "email", "phone": "phone", "tel": "phone", "call": "phone", "fax": "phone", "mobile": "phone", "card": "card", "visa": "card", "ip": "ip", "host": "ip", "server": "ip",
    "order": "no", "no": "no", "ref": "no", "version": "no", "v": "no", "id": "no", "invoice": "no", "commit": "no", "sha": "no", "hash": "no", "md": "no", "checksum": "no", "uuid": "no", "build": "no",
    "token": "secret", "key": "secret", "secret": "secret", "password": "secret", "passwd": "secret", "bearer": "secret", "auth": "secret", "apikey": "secret",
}
#: A written at-sign: in brackets, or said together with a dot.
_AT = re.compile(r"[\[({] ?at ?[\])}]|(?<=\s)at(?=\s+[a-z0-9-]+(?:\s+dot\s|\s?[\[({] ?dot))", re.I)
_DOT = re.compile(r"\.|\s?[\[({] ?dot ?[\])}]\s?|\s+dot\s+", re.I)


def pieces(text: str) -> Iterator[tuple[int, int]]:
    """Stretches that can hold an entity: words with digits, "@" or a written at-sign, with two words on each side."""
    spots = [m.start() for m in re.finditer(r"[0-9@]+", text)] + [m.start() for m in _AT.finditer(text)]
    if not spots:
        return
    spots.sort()
    start, last = None, None
    for s in spots:
        if start is None:
            start, last = s, s
        elif s - last <= 24:
            last = s
        else:
            yield _widen(text, start, last)
            start, last = s, s
    yield _widen(text, start, last)


def _widen(text: str, start: int, end: int) -> tuple[int, int]:
    """Out to the third white space on each side (the sixth after a written at-sign), REACH characters at most, and over the run of digits at the end."""
    a, b, n = start, end, len(text)
    while b < n and text[b] in "0123456789@":
        b += 1
    left, right, seen, most = max(0, a - REACH), min(n, b + REACH), 0, 6 if _AT.match(text, end) else 3
    while a > left:
        a -= 1
        if text[a].isspace():
            seen += 1
            if seen == 3:
                break
    seen = 0
    while b < right:
        if text[b].isspace():
            seen += 1
            if seen == most:
                break
        b += 1
    return a, b


def _features(tokens: list[str], i: int, j: int) -> list[str] | None:
    """Features of tokens[i:j] as one segment; None where it can't be an entity."""
    first, last = tokens[i], tokens[j - 1]
    if not (first.isalnum() or first in "+(") or not last.isalnum():
        return None
    span = tokens[i:j]
    text = "".join(span)
    digits = "".join(c for c in text if "0" <= c <= "9")
    written = len(_AT.findall(text))
    at = text.count("@") + written
    mixed = j - i == 1 and len(text) >= 16 and not text.isalpha() and not text.isdigit()
    if at != 1 and len(digits) < 7 and not mixed or "\n" in text or at > 1:
        return None
    alpha = any(c.isalpha() for c in text)
    seps = "".join(sorted({c for c in text if not c.isalnum()}))
    groups = [len(t) for t in span if t.isdigit()]
    before = next((t.lower() for t in reversed(tokens[max(0, i - 6) : i]) if t.isalpha()), "")
    prev, nxt = (tokens[i - 1][-1] if i else " "), (tokens[j][0] if j < len(tokens) else " ")
    f = ["bias", f"at{at}", f"alpha{alpha}", f"nd{min(len(digits), 20)}", f"seps{seps}", f"cue{_CUES.get(before, '')}"]
    f.append("left" + ("." if prev in ".-@_%" else "w" if prev.isalnum() else "+" if prev in "+(" else "o"))
    f.append("right" + ("@" if nxt in "@_" else "w" if nxt.isalnum() else "o"))
    if nxt in ".-" and j + 1 < len(tokens) and tokens[j + 1].isalnum():
        f.append("more")
    if mixed:
        f += [f"mixed{_CUES.get(before, '')}", f"long{min(len(text) // 8, 8)}", f"hex{all(c in '0123456789abcdef' for c in text.lower())}", f"cases{text.lower() != text != text.upper()}"]
    elif alpha and not at:
        f.append("words")
    if not alpha:
        f += [f"lead{digits[0] if digits[0] in '01' else ''}", f"lead{digits[0] if digits[0] in '01' else ''}{seps}{len(digits)}", "groups" + "-".join(map(str, groups[:7])), f"ng{min(len(groups), 8)}"]
        if 16 <= len(digits) <= 19:
            f.append(f"luhn{luhn(digits)}")
        if len(groups) == 4 and seps == "." and all(g <= 3 for g in groups):
            f.append("quad" + str(all(int(t) <= 255 for t in span if t.isdigit())))
        if first in "+(":
            f.append("opens" + first)
        if text.count("(") != text.count(")"):
            f.append("unbalanced")
    elif at:
        user, host = (x.strip() for x in (text.split("@", 1) if not written else _AT.split(text, maxsplit=1)))
        parts = _DOT.split(host)
        f.append(f"host{min(len(parts), 4)}{all(re.fullmatch('[A-Za-z0-9-]+', p) for p in parts)}")
        f.append(f"user{bool(re.fullmatch('[A-Za-z0-9._%+-]+', user))}{written}")
        f.append(f"top{parts[-1].isalpha() and 2 <= len(parts[-1]) <= 6}")
    return f


def segments(tokens: list[str]) -> list[tuple[int, int, list[str]]]:
    n, out = len(tokens), []
    for i in range(n):
        if tokens[i][0].isspace():
            continue
        for j in range(i + 1, min(n, i + MAX_TOKENS) + 1):
            if tokens[j - 1] == "\n":
                break
            f = _features(tokens, i, j)
            if f is not None:
                out.append((i, j, f))
    return out


def _scores(segs, weights: dict[str, list[float]]) -> list[tuple[int, int, list[float]]]:
    out = []
    for i, j, f in segs:
        s = [0.0] * len(KINDS)
        for x in f:
            w = weights.get(x)
            if w:
                for k in range(len(KINDS)):
                    s[k] += w[k]
        out.append((i, j, s))
    return out


def decode(tokens: list[str], weights: dict[str, list[float]]) -> list[tuple[int, int, int]]:
    """Best segmentation: (i, j, kind) of its entities; single tokens outside entities score 0."""
    n = len(tokens)
    ends: dict[int, list] = {}
    for i, j, s in _scores(segments(tokens), weights):
        k = max(range(len(KINDS)), key=s.__getitem__)
        if s[k] > 0:
            ends.setdefault(j, []).append((i, k, s[k]))
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for i, k, s in ends.get(j, ()):
            if best[i] + s > best[j]:
                best[j], back[j] = best[i] + s, (i, k)
    out, j = [], n
    while j:
        if back[j]:
            i, k = back[j]
            out.append((i, j, k))
            j = i
        else:
            j -= 1
    return out[::-1]


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def _sentences(seed: int, n: int) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """Generated sentences with their entities as (start, end, kind)."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(["the", "an", "er", "ou", "re", "ti", "sch", "en", "la"]) for _ in range(r.randint(1, 3)))

    def card(valid: bool) -> str:
        base = d(15)
        good = next(c for c in "0123456789" if luhn(base + c))
        return base + (good if valid else str((int(good) + r.randint(1, 9)) % 10))

    def entity() -> tuple[str, int]:
        kind = r.randrange(5)
        if kind == 0:
            user = word() + r.choice(["", "." + d(2), d(2), "." + word(), "_" + word(), "-" + word()])
            host = word() + r.choice(["", d(1), "-" + word()]) + r.choice(["", "", "." + word()])
            at, dot = r.choice([("@", "."), ("@", "."), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", "."), (" at ", " dot "), ("{at}", "{dot}"), (" AT ", " DOT ")])
            host = host if r.random() < 0.5 else host.replace(".", dot)
            return user + at + host + dot + r.choice(["example", word()]) + dot + r.choice(["com", "org", "net", "io", "info"]), 0
        if kind == 1:
            return ".".join(str(r.randint(1, 255)) for _ in range(4)), 1
        if kind == 2:
            c, s = card(True), r.choice(["", " ", "-", "."])
            return s.join(c[k : k + 4] for k in range(0, 16, 4)), 2
        if kind == 3:
            a, b, c, g = d(3), d(3), d(4), r.choice(" -.")
            return r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{r.randint(1, 99)} {a} {b} {c}", f"1-{a}-{b}-{c}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(3)}{g}{b}{g}{c}", f"0{d(2)}{g}{d(7)}", f"(0{d(2)}) {d(4)} {d(4)}", f"00{r.randint(10, 99)} {a} {d(7)}", f"{a}.{b}.{c}", f"+{r.randint(10, 99)}{d(10)}"]), 3
        many = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
        return r.choice([random_text("0123456789abcdef", r.choice([32, 40, 64])), random_text(many, r.randint(20, 48)), random_text(many[:36], r.randint(20, 40))]), 4

    def random_text(letters: str, k: int) -> str:
        return "a1" + "".join(r.choice(letters) for _ in range(k - 2))

    def other() -> str:
        return r.choice([f"20{d(2)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{d(1)}.{d(1)}.{d(2)}", f"{d(3)}.{d(2)}", f"{d(8)}", f"{d(10)}", f"{d(12)}", card(False), f"{d(3)}.{r.randint(256, 999)}.{d(1)}.{d(2)}", f"{d(4)}-{d(4)}", f"{d(2)}:{d(2)}:{d(2)}.{d(3)}", f"{d(5)} {d(5)} {d(2)}", "@" + word(), f"{d(7)}", f"a{d(4)}bf{d(3)}c", f"{d(20)}", f"{d(3)} {d(3)} {d(3)} {d(3)}", word() + "@" + word(), f"{r.choice(['commit', 'sha', 'hash', 'checksum', 'build'])} {random_text('0123456789abcdef', r.choice([32, 40]))}", f"at {word()} {d(2)}", f"{word()} at {word()} and {word()} {d(2)}", f"{d(4)} {d(4)} {d(4)}"])

    for _ in range(n):
        text, spans = word(), []
        for _ in range(r.randint(1, 3)):
            text += " " + word() + r.choice(["", "", ",", ".", ":"]) + " "
            if r.random() < 0.25:
                text += r.choice(list(_CUES)) + r.choice([" ", ": "])
            if r.random() < 0.5:
                e, k = entity()
                if k == 4:
                    text += r.choice(["token", "key", "secret", "password", "api_key", "Bearer", "auth"]) + r.choice([" = \"", ": ", "=", " ", "='"])
                spans.append((len(text), len(text) + len(e), k))
                text += e + ("\" " if k == 4 and text.endswith('"') else "") + r.choice(["", "", ".", ",", "!!", "###", "%%%"])
            else:
                text += other()
        yield text + " " + word(), spans


@functools.cache
def train(seed: int = 7, n: int = TRAIN_SENTENCES, rounds: int = 12, rate: float = 0.25) -> dict[str, list[float]]:
    """Maximum likelihood by stochastic gradients; expectations from a forward and a backward pass over segments."""
    examples = []
    for text, spans in _sentences(seed, n):
        found = list(_TOKEN.finditer(text))
        tokens = [m[0] for m in found]
        starts, ends = {m.start(): k for k, m in enumerate(found)}, {m.end(): k + 1 for k, m in enumerate(found)}
        gold = {(starts[a], ends[b]): k for a, b, k in spans if a in starts and b in ends}
        examples.append((tokens, segments(tokens), gold))
    weights: dict[str, list[float]] = {}
    kinds = range(len(KINDS))
    for turn in range(rounds):
        step = rate / (1 + 0.5 * turn)
        for tokens, segs, gold in examples:
            n_tok, scored = len(tokens), _scores(segs, weights)
            by_end: dict[int, list] = {}
            by_start: dict[int, list] = {}
            for i, j, s in scored:
                by_end.setdefault(j, []).append((i, s))
                by_start.setdefault(i, []).append((j, s))
            fwd, bwd = [0.0] * (n_tok + 1), [0.0] * (n_tok + 1)
            for j in range(1, n_tok + 1):
                v = fwd[j - 1]
                for i, s in by_end.get(j, ()):
                    for k in kinds:
                        v = _log_add(v, fwd[i] + s[k])
                fwd[j] = v
            for i in range(n_tok - 1, -1, -1):
                v = bwd[i + 1]
                for j, s in by_start.get(i, ()):
                    for k in kinds:
                        v = _log_add(v, bwd[j] + s[k])
                bwd[i] = v
            total = fwd[n_tok]
            for (i, j, f), (_, _, s) in zip(segs, scored):
                true = gold.get((i, j))
                for k in kinds:
                    g = (1.0 if true == k else 0.0) - math.exp(min(0.0, fwd[i] + s[k] + bwd[j] - total))
                    if abs(g) > 1e-3:
                        for x in f:
                            weights.setdefault(x, [0.0] * len(KINDS))[k] += step * g
    return weights


def model_spans(text: str, weights: dict[str, list[float]]) -> list[tuple[str, int, int]]:
    out = []
    for a, b in pieces(text):
        found = list(_TOKEN.finditer(text, a, b))
        # a piece is cut where nothing can start or go on, so that its length stays bounded: no segment spans 200 tokens
        out += [(KINDS[k], found[i].start(), found[j - 1].end()) for i, j, k in decode([m[0] for m in found], weights)]
    return out


def spans_of(text: str, weights: dict[str, list[float]]) -> tuple[list, list]:
    """(base spans, all spans), each by kind as listed, then start."""
    if not text or not (_ANY.search(text) or _AT.search(text)):
        return [], []
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    added = [s for s in model_spans(text, weights) if not any(a < s[2] and s[1] < b for a, b in taken)]
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted({*base, *added}, key=lambda s: (order[s[0]], s[1], s[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span (overlapping ones as one) replaced by its kind in brackets."""
    if not spans:
        return text
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join(out) + text[end:]


MADE = ("n_email", "n_ip", "n_card", "n_phone", "n_spans", "base_spans", "spans", "redacted")


def find(docs: DataFrame, text_col: str = "text", weights: dict | None = None) -> DataFrame:
    """docs with base counts n_email .. n_phone, base_spans and spans ("kind:start:end", code points) and redacted text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights or train())
    docs = docs.select(*[c for c in docs.columns if c not in MADE])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        for b in batches:
            if b.empty:
                continue
            texts = [t if isinstance(t, str) else None for t in b[text_col]]
            found = [spans_of(t or "", w) for t in texts]
            made = {f"n_{k}": [sum(s[0] == k for s in f[0]) for f in found] for k in BASE_KINDS}
            yield b.assign(**made, n_spans=[len(f[1]) for f in found], base_spans=[_joined(f[0]) for f in found], spans=[_joined(f[1]) for f in found], redacted=[redact(t, f[1]) for t, f in zip(texts, found)])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInPandas(run, f"{kept}, n_email long, n_ip long, n_card long, n_phone long, n_spans long, base_spans string, spans string, redacted string")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = spark.sparkContext.broadcast(train())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        for b in batches:
            if b.empty:
                continue
            found = [spans_of(t if isinstance(t, str) else "", w) for t in b["text"]]
            made = {f"n_{k}": [sum(s[0] == k for s in f[0]) for f in found] for k in BASE_KINDS}
            yield pd.DataFrame({"doc_id": b["doc_id"], **made, "base_sha256": [hashlib.sha256(_joined(f[0]).encode()).hexdigest() for f in found], "spans": [_joined(f[1]) for f in found], "n_spans": [len(f[1]) for f in found], "n_added": [len(f[1]) - len(f[0]) for f in found]})

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInPandas(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, n_added long")
