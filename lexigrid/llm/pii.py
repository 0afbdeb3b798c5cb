"""Personal data: fixed patterns, and a linear-chain conditional random field that adds what they miss.

Patterns find e-mail addresses, IP addresses, card numbers and phone numbers. The field labels white-space tokens by their
shape (digit, letter and mark counts, case, cue words) and their neighbours' shapes; it is trained here, by gradient
ascent on forward-backward expectations, from a small labelled table that ``labelled`` writes out, and decoded by Viterbi over
padded numpy batches. A token may carry a label other than O only if it has a digit or an @, is a cue word, or stands beside an
"at" or "dot"; text decomposes at all others, so only short stretches are decoded and the result is the whole text's.
Its spans are added where they overlap no pattern's; card numbers must pass Luhn, addresses and phone numbers have as many
digits as they may.

Defined cases: null text counts as empty and has no spans; spans are code points, end exclusive; ties of start are ordered
email, ip, card, phone, id; equal rows give equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.textkit import LOWER, flat, python_stage, segments, slices, span_hash, words
from lexigrid.storage import spread

KINDS = ("email", "ip", "card", "phone", "id")
BASE = KINDS[:4]
LABELS = ("O", *KINDS)

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def _part(p: str) -> bool:
    p = p.lstrip("0")
    return len(p) <= 3 and int(p or "0") <= 255


def emails(text: str) -> list[tuple[int, int]]:
    """Each @ is tried with the characters before it that may belong to it: the leftmost match, in linear time."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_SET:
            start -= 1
        nxt = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = nxt = m.end()
        else:
            end = nxt
        at = text.find("@", nxt)
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all patterns, by start, then kind."""
    out = [(s, e, 0) for s, e in emails(text)]
    out += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(map(_part, m[0].split(".")))]
    out += [(m.start(), m.end(), 2) for m in _CARD.finditer(text) if 14 <= len(d := _DIGITS.sub("", m[0])) <= 19 and luhn(d)]
    out += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.sub("", m[0])) <= 15]
    return [(s, e, KINDS[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2]))]


# --- shapes ---

_FIELDS = ({"digit": b"0123456789", "lower": bytes(range(97, 123)), "upper": bytes(range(65, 91)), "at": b"@", "dot": b".", "dash": b"-", "paren": b"()[]<>", "colon": b":/\\"}, {"plus": b"+", "quote": b"\"'`", "symbol": b"#$%&*^~=|_{}", "shout": b"!?,;", "wide": bytes(range(128, 256))})
_COUNTERS = []
for _group in _FIELDS:
    _t = np.zeros(256, np.uint64)
    for _k, _chars in enumerate(_group.values()):
        _t[list(_chars)] += np.uint64(1 << (8 * _k))
    _COUNTERS.append(_t)

_CUES = {"at": "at (at) [at] {at} <at>", "dot": "dot (dot) [dot] {dot} <dot>", "phone": "phone phone: tel tel: tel. call call: mobile mobile: fax fax:", "mail": "email email: e-mail e-mail: mail mail: contact contact:", "card": "card card: visa mastercard", "ssn": "ssn ssn: ssn# passport passport:"}
_CUE_NAMES = tuple(_CUES)


def _cue_table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    all_ = [(w, k) for k, c in enumerate(_CUES.values(), 1) for w in c.split()]
    h = [int(span_hash(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0]) for w, _ in all_]
    order = np.argsort(np.array(h, np.uint64))
    starts = np.zeros(65536, bool)
    for w, _ in all_:
        starts[ord(w[0]) * 256 + ord(w[1])] = True
    return np.array(h, np.uint64)[order], np.array([k for _, k in all_])[order], starts


_CUE_HASH, _CUE_KIND, _CUE_START = _cue_table()

_BINS = {"digit": (1, 2, 3, 4, 5, 7, 9, 10, 12, 14, 17, 20), "lower": (1, 3, 5), "upper": (1, 2, 4), "at": (1, 2), "dot": (1, 2, 3, 4), "dash": (1, 2, 3), "paren": (1, 2), "colon": (1, 2), "plus": (1,), "quote": (1,), "symbol": (1,), "shout": (1,), "wide": (1,)}
_WIDTHS = {k: len(v).bit_length() for k, v in _BINS.items()}
FEATURES = [f"{k}>={b}" for k, v in _BINS.items() for b in v] + [f"{k}=0" for k in ("digit", "lower", "at", "dot")] + ["first+", "first(", "firstdigit", "lastdigit", *(f"cue {c}" for c in _CUE_NAMES), "bias"]


def shapes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit code of each token's shape, from which its features follow."""
    code, shift = np.zeros(len(starts), np.int64), 0
    length = ends - starts
    # packed counters of a token of over 255 bytes may run over into each other: its classes are counted one by one
    long = np.flatnonzero(length > 255)
    first_byte = np.cumsum(length[long]) - length[long]
    body = buf[np.repeat(starts[long] - first_byte, length[long]) + np.arange(length[long].sum())]
    for group, table in zip(_FIELDS, _COUNTERS):
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(table[buf], out=total[1:])
        packed = total[ends] - total[starts]
        for k, name in enumerate(group):
            n = (packed >> np.uint64(8 * k)).astype(np.int64) & 255
            if len(long):
                n[long] = np.add.reduceat((table[body] >> np.uint64(8 * k)).astype(np.int64) & 255, first_byte)
            code |= np.searchsorted(_BINS[name], n, "right") << shift
            shift += _WIDTHS[name]
    first, last = buf[starts], buf[ends - 1]
    for flag in (first == 43, first == 40, (first >= 48) & (first <= 57), (last >= 48) & (last <= 57)):
        code |= flag.astype(np.int64) << shift
        shift += 1
    low = LOWER[buf]
    maybe = np.flatnonzero((length > 1) & (length < 11))
    maybe = maybe[_CUE_START[low[starts[maybe]].astype(np.int64) * 256 + low[starts[maybe] + 1]]]
    if len(maybe):
        h = span_hash(low, starts[maybe], ends[maybe])
        at = np.minimum(np.searchsorted(_CUE_HASH, h), len(_CUE_HASH) - 1)
        code[maybe] |= np.where(_CUE_HASH[at] == h, _CUE_KIND[at], 0) << shift
    shift += 3
    return code


def feature_matrix(code: np.ndarray) -> np.ndarray:
    cols, shift, level = [], 0, {}
    for group in _FIELDS:
        for name in group:
            level[name] = (code >> shift) & ((1 << _WIDTHS[name]) - 1)
            shift += _WIDTHS[name]
    for name, bins in _BINS.items():
        cols += [level[name] > k for k in range(len(bins))]
    cols += [level[k] == 0 for k in ("digit", "lower", "at", "dot")]
    cols += [(code >> (shift + k)) & 1 for k in range(4)]
    cue = (code >> (shift + 4)) & 7
    cols += [cue == k for k in range(1, len(_CUE_NAMES) + 1)]
    return np.stack([*cols, np.ones(len(code))], 1).astype(np.float32)


_SHIFT = sum(_WIDTHS[k] for g in _FIELDS for k in g)


def open_tokens(code: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Tokens that may carry a label other than O."""
    cue = (code >> (_SHIFT + 4)) & 7
    digit = code & ((1 << _WIDTHS["digit"]) - 1)
    at_shift = _WIDTHS["digit"] + _WIDTHS["lower"] + _WIDTHS["upper"]
    has_at = (code >> at_shift) & ((1 << _WIDTHS["at"]) - 1)
    link = (cue == 1) | (cue == 2)
    free = (digit > 0) | (has_at > 0) | (cue > 0)
    same = row[1:] == row[:-1]
    free[1:] |= link[:-1] & same
    free[:-1] |= link[1:] & same
    return free


# --- the field ---


def labelled(n: int = 900, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """The labelled table: sentences of made-up words with personal data in many shapes, and with numbers that are none."""
    r = random.Random(seed)
    syllables = "an ber con du el for gra hi in jo ka lo men ni or pa que re son ti un ver wi za é ü".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    tail = lambda: r.choice(("", "", "", ".", ",", "!!", "***", ";", "%%%"))

    def filler() -> str:
        w = word()
        return r.choice((w, w, w, w.upper(), w.title(), w + tail()))

    def card() -> str:
        d = r.choice("3456") + digits(14)
        return d + next(c for c in "0123456789" if luhn(d + c))

    def positive() -> tuple[list[str], str]:
        user, host, top = word() + r.choice(("", ".", "_", "")) + word() + r.choice(("", digits(2))), word(), r.choice(("com", "org", "net", "fr", "example.com"))
        at, dot = r.choice((("[at]", "[dot]"), ("(at)", "(dot)"), ("at", "dot"), ("[AT]", "[DOT]")))
        a, b, c = digits(3), digits(3), digits(4)
        n = card()
        four = [n[i : i + 4] for i in range(0, 16, 4)]
        ip = ".".join(str(r.randint(0, 255)) for _ in range(4))
        return r.choice((
            ([f"{user}@{host}.{top}" + tail()], "email"), ([f"<{user}@{host}.{top}>"], "email"), ([user, at, host, dot, top.split(".")[0]], "email"), ([user, at, host, dot, "com" + tail()], "email"),
            ([ip + tail()], "ip"), ([ip], "ip"), ([n + tail()], "card"), (four, "card"), (["-".join(four) + tail()], "card"),
            (["+1", f"({a})", f"{b}-{c}" + tail()], "phone"), ([f"({a})", f"{b}-{c}" + tail()], "phone"), ([f"{a}-{b}-{c}" + tail()], "phone"), ([f"+{digits(2)}", digits(2), c, digits(4)], "phone"), ([f"{a}.{b}.{c}"], "phone"), ([f"+{digits(11)}"], "phone"),
            ([f"{a}-{digits(2)}-{c}" + tail()], "id"),
        ))

    def negative() -> list[str]:
        return r.choice((
            [digits(r.randint(1, 6)) + tail()], [str(r.randint(1900, 2030)) + tail()], [f"{r.randint(0, 9)}.{r.randint(0, 99)}" + tail()], [f"v{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}"], ["Version", "2.0."], [f"{r.randint(1, 31)}/{r.randint(1, 12)}/{r.randint(1900, 2030)}"],
            [f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}"], ['"' + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"'], [f"http://{word()}.org/{word()}{digits(2)}"], [f"{digits(2)},{digits(3)}"], [f"@{word()}"], ["|", word(), "|", digits(2), "|"],
            [f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}"], [digits(r.randint(20, 40))], [f"{word()}-{word()}"], ["at", "the", word()], ["look", "at", word()], ["dot", word()], [f"({digits(4)})"], ["call", word()], ["card", word()], [f"{digits(2)}:{digits(2)}"], [f"{digits(2)}%"], [f"${digits(3)}.{digits(2)}"], [f"{word()}{digits(2)}"], [digits(3), digits(2)], [digits(3), digits(4)],
        ))

    cue = {"email": ("email", "mail:", "contact"), "phone": ("phone:", "call", "tel."), "card": ("card", "visa"), "ip": (), "id": ("ssn", "SSN:", "passport")}
    table = []
    for _ in range(n):
        t: list[str] = []
        y: list[str] = []
        for _ in range(r.randint(1, 3)):
            t += (fill := [filler() for _ in range(r.randint(1, 4))])
            y += ["O"] * len(fill)
            if r.random() < 0.5:
                tokens, kind = positive()
                if cue[kind] and r.random() < 0.3:
                    t.append(r.choice(cue[kind]))
                    y.append("O")
                t += tokens
                y += [kind] * len(tokens)
            else:
                t += (tokens := negative())
                y += ["O"] * len(tokens)
        t.append(filler())
        y.append("O")
        table.append((t, y))
    return table


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis))


def along(a: np.ndarray, ways: np.ndarray) -> np.ndarray:
    """Logarithms of sums over the labels before, each times its way."""
    m = a.max(1, keepdims=True)
    return m + np.log(np.exp(a - m) @ ways)


@lru_cache(maxsize=2)
def train(steps: int = 220, rate: float = 0.1, ridge: float = 2e-4, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(weights of own, previous and next features by label; transition scores)."""
    table = labelled(seed=seed)
    buf = np.frombuffer("\n".join(" ".join(t) for t, _ in table).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(" ".join(t).encode()) + 1 for t, _ in table])])
    off[-1] = len(buf)
    starts, ends, first = words(buf, off)
    row, code = segments(first), shapes(buf, starts, ends)
    codes, which = np.unique(code, return_inverse=True)  # few shapes: products are made for each shape once
    x, free = feature_matrix(codes).astype(np.float64), open_tokens(code, row)
    y = np.array([LABELS.index(k) for _, ys in table for k in ys])
    n, size, k = len(table), int(np.diff(first).max()), len(LABELS)
    col = np.arange(len(row)) - first[row]
    real = np.zeros((n, size), bool)
    real[row, col] = True
    y = np.where(free, y, 0)
    gold = np.zeros((len(y), k))
    gold[np.arange(len(y)), y] = 1
    trans_gold = np.zeros((k, k))
    inner = np.flatnonzero(row[1:] == row[:-1])
    np.add.at(trans_gold, (y[inner], y[inner + 1]), 1)
    params = [np.zeros((3, x.shape[1], k)), np.zeros((k, k))]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    shut = np.zeros((len(y), k))
    shut[~free, 1:] = -1e4
    same = (row[1:] == row[:-1])[:, None]

    def by_shape(shape: np.ndarray, d: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(shape, d[:, j], minlength=len(codes)) for j in range(k)], 1)

    for step in range(1, steps + 1):
        w, tr = params
        e = np.zeros((n, size, k))
        own, before, after = ((x @ v)[which] for v in w)
        own[1:] += before[:-1] * same
        own[:-1] += after[1:] * same
        e[row, col] = own + shut
        f = np.zeros((n, size, k))
        f[:, 0] = e[:, 0]
        ways = np.exp(tr)
        for t in range(1, size):
            f[:, t] = np.where(real[:, t, None], along(f[:, t - 1], ways) + e[:, t], f[:, t - 1])
        b = np.zeros((n, size, k))
        pair = np.zeros((k, k))
        z = _logsum(f[:, -1], 1)
        for t in range(size - 2, -1, -1):
            m = e[:, t + 1] + b[:, t + 1]
            fa, ma = f[:, t].max(1), m.max(1)
            weight = np.exp(fa + ma - z) * real[:, t + 1]
            pair += ways * ((np.exp(f[:, t] - fa[:, None]) * weight[:, None]).T @ np.exp(m - ma[:, None]))
            b[:, t] = np.where(real[:, t + 1, None], along(m, ways.T), 0)
        p = np.exp(f + b - z[:, None, None])[row, col]
        d = gold - p
        g = np.stack([x.T @ by_shape(which, d), x.T @ by_shape(which[:-1], d[1:] * same), x.T @ by_shape(which[1:], d[:-1] * same)])
        for i, grad in enumerate((g / n - ridge * w, (trans_gold - pair) / n - ridge * tr)):
            moments[i][0] = 0.9 * moments[i][0] + 0.1 * grad
            moments[i][1] = 0.99 * moments[i][1] + 0.01 * grad**2
            params[i] = params[i] + rate * (moments[i][0] / (1 - 0.9**step)) / (np.sqrt(moments[i][1] / (1 - 0.99**step)) + 1e-8)
    return params[0].astype(np.float32), params[1].astype(np.float32)


def viterbi(e: np.ndarray, size: np.ndarray, trans: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Best labels of padded stretches e (n, longest, labels); left and right: whether an O token stands beside them."""
    n, longest, k = e.shape
    score = e[:, 0] + left[:, None] * trans[0]
    back = np.zeros((n, longest, k), np.int8)
    final = score.copy()
    for t in range(1, longest):
        step = score[:, :, None] + trans
        back[:, t] = step.argmax(1)
        score = step.max(1) + e[:, t]
        final = np.where((size > t)[:, None], score, final)
    best = (final + right[:, None] * trans[:, 0]).argmax(1)
    out = np.zeros((n, longest), np.int8)
    for t in range(longest - 1, -1, -1):
        here = size > t
        out[here, t] = best[here]
        if t:
            best = np.where(here, back[np.arange(n), t, best], best)
    return out


def field_labels(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, model) -> np.ndarray:
    """Label of every token of all rows."""
    weights, trans = model
    label = np.zeros(len(starts), np.int8)
    if not len(starts):
        return label
    row, code = segments(first), shapes(buf, starts, ends)
    at = np.flatnonzero(open_tokens(code, row))
    if not len(at):
        return label
    # emissions are needed at open tokens only
    codes, which = np.unique(code[np.unique(np.concatenate([at, np.maximum(at - 1, 0), np.minimum(at + 1, len(code) - 1)]))], return_inverse=True)
    x = feature_matrix(codes)
    own, before, after = (x @ w for w in weights)
    pick = lambda i: np.searchsorted(codes, code[i])
    e = own[pick(at)].copy()
    prev, nxt = np.maximum(at - 1, 0), np.minimum(at + 1, len(code) - 1)
    has_prev, has_next = (at > 0) & (row[prev] == row[at]) & (prev < at), (nxt > at) & (row[nxt] == row[at])
    e += before[pick(prev)] * has_prev[:, None] + after[pick(nxt)] * has_next[:, None]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(at)))
    last = begin + size - 1
    order = np.argsort(size, kind="stable")
    done = 0
    while done < len(order):
        longest_to = np.searchsorted(size[order], max(8, int(1.5 * size[order[done]])), "right")
        take = order[done : min(max(longest_to, done + 1), done + 4096)]
        longest = int(size[take].max())
        index = np.minimum(begin[take, None] + np.arange(longest), len(at) - 1)
        got = viterbi(e[index], size[take], trans, has_prev[begin[take]], has_next[last[take]])
        real = np.arange(longest) < size[take, None]
        label[at[index[real]]] = got[real]
        done += len(take)
    return label


#: An address with its marks, or with both spelt out.
_SPELT = re.compile(r"[^\s@]@[^\s@]+\.[^\s@]|\w\W+at\W+\w[\w.-]*\W+dot\W+\w", re.I)
_EDGE = " \t\n\r\x0b\x0c.,;:!?\"'`*%$#&|<>[]{}()="


def field_spans(text: str, tokens: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """Spans of runs of equally labelled tokens (byte start, byte end, label) that pass the kind's check."""
    raw = text.encode("utf-8", "surrogatepass")
    out, i, seen, chars = [], 0, 0, 0
    while i < len(tokens):
        j = i
        while j + 1 < len(tokens) and tokens[j + 1][2] == tokens[i][2] and not raw[tokens[j][1] : tokens[j + 1][0]].strip():
            j += 1
        kind = LABELS[tokens[i][2]]
        body = raw[tokens[i][0] : tokens[j][1]].decode("utf-8", "surrogatepass")
        chars += len(raw[seen : tokens[i][0]].decode("utf-8", "surrogatepass"))
        seen, start = tokens[i][0], chars
        lead = len(body) - len(body.lstrip(_EDGE.replace("(", "") if kind == "phone" else _EDGE))
        core = body[lead:].rstrip(_EDGE)
        d = _DIGITS.sub("", core)
        ok = {"email": bool(_SPELT.search(core)), "ip": len(core.split(".")) == 4 and all(p.isdigit() and _part(p) for p in core.split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15, "id": len(d) == 9}[kind]
        if ok:
            out.append((start + lead, start + lead + len(core), kind))
        i = j + 1
    return out


def apart(more: list[tuple[int, int, str]], found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans of ``more`` that overlap none of ``found``, which is ordered by start."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e, _ in found:  # joined where they overlap
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    at = [bisect_right(ends, m[0]) for m in more]
    return [m for m, i in zip(more, at) if i == len(ends) or starts[i] >= m[1]]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans): each an array of (start, end, kind); the second has the field's too."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model = train()
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            buf, off = flat(part.column("text"))
            starts, ends, first = words(buf, off)
            label = field_labels(buf, starts, ends, first, model)
            hit = np.flatnonzero(label)
            hits = np.searchsorted(hit, first)
            # a pattern needs an @, or four digits
            full = np.flatnonzero(np.diff(off) > 0)
            marks, digits = np.zeros(len(off) - 1, np.int64), np.zeros(len(off) - 1, np.int64)
            if len(full):
                marks[full] = np.add.reduceat((buf == 64).astype(np.int64), off[:-1][full])
                digits[full] = np.add.reduceat(((buf >= 48) & (buf <= 57)).astype(np.int64), off[:-1][full])
            base, spans = [], []
            for i in range(part.num_rows):
                own = hit[hits[i] : hits[i + 1]]
                text = part.column("text")[i].as_py() or "" if marks[i] or digits[i] >= 4 or len(own) else ""
                found = base_spans(text) if text else []
                base.append([{"start": s, "end": e, "kind": k} for s, e, k in found])
                if len(own):
                    more = field_spans(text, [(int(starts[t] - off[i]), int(ends[t] - off[i]), int(label[t])) for t in own])
                    found = sorted(found + apart(more, found), key=lambda x: (x[0], KINDS.index(x[2])))
                spans.append([{"start": s, "end": e, "kind": k} for s, e, k in found])
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(base, pa.list_(span)), pa.array(spans, pa.list_(span))], ["id", "base", "spans"])

    shape = "array<struct<start: bigint, end: bigint, kind: string>>"
    return rows.transform(python_stage, run, f"id {rows.schema['id'].dataType.simpleString()}, base {shape}, spans {shape}")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with every span replaced by its kind in brackets; null text stays null."""
    found = find(docs, id_col, text_col).select(F.col("id").alias("_id"), "spans")
    both = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(found, F.col("id").eqNullSafe(F.col("_id")))
    cut = F.aggregate("spans", F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")), lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(F.concat(a["out"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].alias("at"))), lambda a: F.concat(a["out"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.length("text"))))
    return both.select("id", cut.alias("text"))


def op8_pii(spark, sf_dir: str) -> DataFrame:
    got = find(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    n = [count(k) for k in BASE]
    return got.select(F.col("id").alias("doc_id"), *n, F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"))
