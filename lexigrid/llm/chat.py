"""Chat formatting by a small template compiler.

A template is parsed into a syntax tree, constants are folded, and the tree becomes nested Python closures that write
into a sink as they go, so a conversation is never held as a whole by the renderer. The language has text,
``{{ expression }}``, ``for``, ``if / elif / else``, ``set`` and ``generation`` blocks; expressions have literals, names,
subscripts, ``+ == != < > <= >= in and or not`` and filters. It is sandboxed: names reach only the values given, dots and
subscripts read only dicts, lists and strings, there are no calls, and filters come from a fixed table.

Control strings inside a text get a backslash after their first character (one more if it already has some), which
``unguard`` takes away again, so texts can never close a turn and come back unchanged.

Defined cases: null role or text counts as empty; turns are ordered by turn (null first), role, text, so repeated turns all
stay; a null conv_id is a conversation of its own; an empty table gives only what is added to it; other columns are
ignored. A conversation is one string in one place by definition; its turns are streamed from a sorted partition, so
even one that holds a third of all rows takes the memory of a turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.textkit import python_stage

TURNS = "{% for m in messages %}{{ '<s>' + '[INST]' }}{{ m.role | guard }}[/INST]{% if m['role'] == 'assistant' %}{% generation %}{{ m.text | guard }}{% endgeneration %}{% else %}{{ m.text | guard }}{% endif %}</s>{% endfor %}"

_GUARD = re.compile(r"(<)(\\*)(/?s>)|(\[)(\\*)(/?INST\])")
_UNGUARD = re.compile(r"(<)(\\*)\\(/?s>)|(\[)(\\*)\\(/?INST\])")
TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.S)


def guard(text: str) -> str:
    return _GUARD.sub(lambda m: m[1] + m[2] + "\\" + m[3] if m[1] else m[4] + m[5] + "\\" + m[6], text)


def unguard(text: str) -> str:
    return _UNGUARD.sub(lambda m: m[1] + m[2] + m[3] if m[1] else m[4] + m[5] + m[6], text)


FILTERS: dict[str, Callable] = {"guard": lambda v: guard(str(v)), "trim": lambda v: str(v).strip(), "upper": lambda v: str(v).upper(), "lower": lambda v: str(v).lower(), "length": lambda v: len(v), "string": str}


class TemplateError(ValueError):
    pass


# --- parsing ---

_TAG = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+<>()\[\].,|]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _lex(source: str) -> list[tuple[str, object]]:
    out: list[tuple[str, object]] = []
    at, source = 0, source.strip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at:]!r}")
        if m[1]:
            out.append(("const", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), m[1][1:-1])))
        elif m[2]:
            out.append(("const", int(m[2])))
        elif m[3]:
            fixed = {"true": True, "false": False, "none": None}
            out.append(("const", fixed[m[3].lower()]) if m[3].lower() in fixed else ("name", m[3]))
        else:
            out.append(("op", m[4]))
        at = m.end()
    return out


class _Expression:
    """Recursive descent; a node is ('const', v), ('name', n), ('item', a, b), ('filter', a, name), ('not', a) or (op, a, b)."""

    def __init__(self, source: str):
        self.tokens, self.at = _lex(source), 0

    def peek(self, *want: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "const" and self.tokens[self.at][1] in want

    def take(self, *want: str) -> bool:
        if self.peek(*want):
            self.at += 1
            return True
        return False

    def parse(self):
        node = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def either(self):
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self):
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        node = self.added()
        while self.peek("==", "!=", "<", ">", "<=", ">=", "in"):
            op = self.tokens[self.at][1]
            self.at += 1
            node = (op, node, self.added())
        return node

    def added(self):
        node = self.filtered()
        while self.take("+"):
            node = ("+", node, self.filtered())
        return node

    def filtered(self):
        node = self.atom()
        while True:
            if self.take("."):
                node = ("item", node, ("const", self.word()))
            elif self.take("["):
                node = ("item", node, self.either())
                if not self.take("]"):
                    raise TemplateError("] is missing")
            elif self.take("|"):
                if (name := self.word()) not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                node = ("filter", node, name)
            else:
                return node

    def word(self) -> str:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("", None)
        if kind != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return value

    def atom(self):
        if self.take("("):
            node = self.either()
            if not self.take(")"):
                raise TemplateError(") is missing")
            return node
        if self.at >= len(self.tokens) or self.tokens[self.at][0] == "op":
            raise TemplateError("an expression is missing")
        self.at += 1
        return self.tokens[self.at - 1]


def parse(source: str) -> list[tuple]:
    """Syntax tree: ('text', s), ('put', e), ('for', name, e, body), ('if', [(e, body)...]), ('set', name, e), ('generation', body)."""
    root: list[tuple] = []
    stack: list[tuple[str, list]] = [("", root)]
    at = 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            stack[-1][1].append(("text", source[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            stack[-1][1].append(("put", _Expression(m[1]).parse()))
            continue
        word, _, rest = m[2].strip().partition(" ")
        if word == "for":
            if not (f := re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)):
                raise TemplateError(f"cannot read for {rest!r}")
            body: list[tuple] = []
            stack[-1][1].append(("for", f[1], _Expression(f[2]).parse(), body))
            stack.append(("for", body))
        elif word == "if":
            body = []
            stack[-1][1].append(("if", [(_Expression(rest).parse(), body)]))
            stack.append(("if", body))
        elif word in ("elif", "else"):
            if stack[-1][0] != "if":
                raise TemplateError(f"{word} outside if")
            stack.pop()
            body = []
            stack[-1][1][-1][1].append((_Expression(rest).parse() if word == "elif" else ("const", True), body))
            stack.append(("if", body))
        elif word == "set":
            name, _, value = rest.partition("=")
            stack[-1][1].append(("set", name.strip(), _Expression(value).parse()))
        elif word == "generation":
            body = []
            stack[-1][1].append(("generation", body))
            stack.append(("generation", body))
        elif word.startswith("end") and stack[-1][0] == word[3:] != "":
            stack.pop()
        else:
            raise TemplateError(f"unexpected {word!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    if at < len(source):
        root.append(("text", source[at:]))
    return root


# --- constant folding ---

_OPS: dict[str, Callable] = {
    "+": lambda a, b: a + b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b,
}


def fold_expression(e: tuple) -> tuple:
    kind = e[0]
    if kind in ("const", "name"):
        return e
    if kind == "filter":
        a = fold_expression(e[1])
        return ("const", FILTERS[e[2]](a[1])) if a[0] == "const" else ("filter", a, e[2])
    if kind == "not":
        a = fold_expression(e[1])
        return ("const", not a[1]) if a[0] == "const" else ("not", a)
    a, b = fold_expression(e[1]), fold_expression(e[2])
    if kind in ("and", "or") and a[0] == "const":
        return b if bool(a[1]) == (kind == "and") else a
    if kind in _OPS and a[0] == b[0] == "const":
        return ("const", _OPS[kind](a[1], b[1]))
    return (kind, a, b)


def fold(tree: list[tuple]) -> list[tuple]:
    """Evaluate what is constant, drop branches that never run, and join neighbouring text."""
    out: list[tuple] = []
    for node in tree:
        if node[0] == "put" and (e := fold_expression(node[1]))[0] == "const":
            made = [("text", _shown(e[1]))]
        elif node[0] == "put":
            made = [("put", e)]
        elif node[0] == "for":
            made = [("for", node[1], fold_expression(node[2]), fold(node[3]))]
        elif node[0] == "set":
            made = [("set", node[1], fold_expression(node[2]))]
        elif node[0] == "generation":
            made = [("generation", fold(node[1]))]
        elif node[0] == "if":
            arms, made = [], None
            for e, body in node[1]:
                e = fold_expression(e)
                if e[0] == "const" and not e[1]:
                    continue
                if e[0] == "const" and not arms:
                    made = fold(body)
                    break
                arms.append((e, fold(body)))
                if e[0] == "const":
                    break
            made = made if made is not None else [("if", arms)] if arms else []
        else:
            made = [node]
        for m in made:
            if m[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + m[1])
            else:
                out.append(m)
    return out


def _shown(v) -> str:
    return "" if v is None else str(v)


# --- closures ---


def _item(a, b):
    if isinstance(a, dict):
        return a.get(b)
    if isinstance(a, (list, str)) and isinstance(b, int) and -len(a) <= b < len(a):
        return a[b]
    return None


def _compile_expression(e: tuple) -> Callable[[dict], object]:
    kind = e[0]
    if kind == "const":
        return lambda env, v=e[1]: v
    if kind == "name":
        return lambda env, n=e[1]: env.get(n)
    if kind == "filter":
        a, f = _compile_expression(e[1]), FILTERS[e[2]]
        return lambda env: f(a(env))
    if kind == "not":
        a = _compile_expression(e[1])
        return lambda env: not a(env)
    a, b = _compile_expression(e[1]), _compile_expression(e[2])
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    op = _item if kind == "item" else _OPS[kind]
    return lambda env: op(a(env), b(env))


def _compile(tree: list[tuple]) -> Callable[[dict, object], None]:
    steps = [_compile_node(n) for n in tree]
    if len(steps) == 1:
        return steps[0]

    def run(env, sink):
        for s in steps:
            s(env, sink)

    return run


def _compile_node(node: tuple) -> Callable[[dict, object], None]:
    kind = node[0]
    if kind == "text":
        return lambda env, sink, s=node[1]: sink.write(s)
    if kind == "put":
        e = _compile_expression(node[1])
        return lambda env, sink: sink.write(_shown(e(env)))
    if kind == "set":
        e = _compile_expression(node[2])
        return lambda env, sink, n=node[1]: env.__setitem__(n, e(env))
    if kind == "generation":
        body = _compile(node[1])

        def marked(env, sink):
            sink.mark(True)
            body(env, sink)
            sink.mark(False)

        return marked
    if kind == "if":
        arms = [(_compile_expression(e), _compile(b)) for e, b in node[1]]

        def choose(env, sink):
            for test, body in arms:
                if test(env):
                    return body(env, sink)

        return choose
    name, e, body = node[1], _compile_expression(node[2]), _compile(node[3])

    def loop(env, sink):
        held = env.get(name), env.get("loop")
        it, i = iter(e(env) or ()), 0
        end = object()
        now = next(it, end)
        while now is not end:
            then = next(it, end)  # one ahead, for loop.last
            env[name], env["loop"] = now, {"index0": i, "index": i + 1, "first": i == 0, "last": then is end}
            body(env, sink)
            now, i = then, i + 1
        env[name], env["loop"] = held

    return loop


class Rendered:
    """Sink that keeps the text and the spans under generation marks."""

    def __init__(self):
        self.parts: list[str] = []
        self.at = 0
        self.spans: list[list[int]] = []

    def write(self, s: str) -> None:
        self.parts.append(s)
        self.at += len(s)

    def mark(self, on: bool) -> None:
        self.spans.append([self.at, self.at]) if on else self.spans[-1].__setitem__(1, self.at)

    @property
    def text(self) -> str:
        return "".join(self.parts)


class ReadBack:
    """Sink that reads turns back from the written text, a turn at a time, and digests them and what is under the marks."""

    def __init__(self):
        self.buffer, self.turns, self.chars, self.loss_chars = "", 0, 0, 0
        self.turns_sha, self.loss_sha = hashlib.sha256(), hashlib.sha256()
        self.masked: list[str] | None = None

    def write(self, s: str) -> None:
        self.chars += len(s)
        self.buffer += s
        if self.masked is not None:
            self.masked.append(s)
        if s.endswith("</s>") and (m := TURN.fullmatch(self.buffer)):
            self.turns_sha.update(f"{unguard(m[1])}\n{unguard(m[2])}\n".encode("utf-8", "surrogatepass"))
            self.turns += 1
            self.buffer = ""

    def mark(self, on: bool) -> None:
        if on:
            self.masked = []
        else:
            text = unguard("".join(self.masked or []))
            self.loss_chars += len(text)
            self.loss_sha.update(text.encode("utf-8", "surrogatepass"))
            self.masked = None


class Template:
    def __init__(self, source: str):
        self.tree = fold(parse(source))
        self.run = _compile(self.tree)

    def render(self, messages, **env) -> Rendered:
        self.run({"messages": messages, **env}, sink := Rendered())
        return sink


def _messages(rows) -> Iterator[dict]:
    return ({"role": r or "", "text": t or ""} for _, r, t in rows)


def _by_conversation(batches: Iterator[pa.RecordBatch]):
    rows = (r for b in batches for r in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist()))
    return groupby(rows, key=lambda r: r[0])


def _placed(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def format_chats(turns: DataFrame, template: str = TURNS) -> DataFrame:
    """(conv_id, formatted, loss_starts, loss_ends): each conversation's string and its code-point spans under the mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Template(template)
        for conv, rows in _by_conversation(batches):
            got = t.render(_messages(rows))
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([got.text], pa.string()), pa.array([[s for s, _ in got.spans]], pa.list_(pa.int64())), pa.array([[e for _, e in got.spans]], pa.list_(pa.int64()))], ["conv_id", "formatted", "loss_starts", "loss_ends"])

    return _placed(turns).transform(python_stage, run, "conv_id bigint, formatted string, loss_starts array<bigint>, loss_ends array<bigint>")


def digest_chats(turns: DataFrame, template: str = TURNS) -> DataFrame:
    """What can be read back from each formatted conversation."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Template(template)
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
            out.clear()
            return made

        for conv, rows in _by_conversation(batches):
            t.run({"messages": _messages(rows)}, s := ReadBack())
            out.append((conv, s.turns, s.turns_sha.hexdigest(), s.loss_chars, s.loss_sha.hexdigest(), s.chars))
            if len(out) >= 5000:
                yield batch()
        yield batch()

    return _placed(turns).transform(python_stage, run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def op9_chat(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return digest_chats(turns.unionByName(extra))


OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
u AS (SELECT *, len(regexp_extract_all(role, '<\\*/?s>|\[\\*/?INST\]')) + len(regexp_extract_all(text, '<\\*/?s>|\[\\*/?INST\]')) AS guards FROM t)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(20 + length(role) + length(text) + guards) AS BIGINT) AS formatted_chars
FROM u GROUP BY conv_id
"""
