"""Chat formatting by schema fingerprints.

Records of any layout arrive as JSON.  A record's nested field paths (array
items written ``[]``), as far as a mapping knows them, are sorted and hashed:
the schema fingerprint.  It selects a declarative mapping, which says which
fields hold turns, their roles and texts, and in which order.  A record that
has the fields of several mappings goes to the one that requires most, the
first listed of equals; known fields that it does not read are named in
``unused``.  No guessing by content and no code per data set: a new layout is a
new entry in ``MAPPINGS``.

The template writes a turn as ``<|im_start|>role``, a line break, the text and
``<|im_end|>`` with a line break.  Inside texts and roles every ``<`` that a bar
follows, with any number of backslashes between, gets one backslash more, so no
control string can appear in them and taking one backslash back restores the
text exactly; a role's line breaks are written as a backslash and n.  The loss
mask is the list of code point spans of the assistant texts.

Formatting is row by row; a conversation is one record, held whole by one task.

Defined results: a null text is empty; a null role is empty; an unknown layout
or invalid JSON gives no turns (``layout`` null) and an empty string; turns keep their order,
rows of one turn number are ordered by role and text; other columns pass
through untouched.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equilibra.llm.common import add_columns, fresh

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"

SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

# Declarative mappings.  "list": an array of turns; "fields": one turn per listed field group, in order;
# "parts": where a turn's text is an array, the path of its pieces; a name with "?" may be missing.
MAPPINGS = (
    {"name": "turn rows", "list": "turns", "role": "role", "text": "text", "order": ("turn", "role", "text")},
    {"name": "messages", "list": "messages", "role": "role", "text": "content", "rename": SPEAKERS},
    {"name": "message parts", "list": "messages", "role": "role", "text": "content[].text", "rename": SPEAKERS},
    {"name": "messages and parts", "list": "messages", "role": "role", "text": "content", "parts": "content[].text", "rename": SPEAKERS},
    {"name": "speakers", "list": "conversations", "role": "from", "text": "value", "rename": SPEAKERS},
    {"name": "prompt and response", "fields": ((LOSS_ROLE, ("response",)),), "before": (("user", ("context?", "prompt", "input?")),)},
    {"name": "prompt and completion", "fields": ((LOSS_ROLE, ("completion",)),), "before": (("user", ("context?", "prompt", "input?")),)},
    {"name": "instruction", "fields": ((LOSS_ROLE, ("output",)),), "before": (("user", ("instruction", "context?", "input?")),)},
    {"name": "instruction and response", "fields": ((LOSS_ROLE, ("response",)),), "before": (("user", ("instruction", "context?", "input?")),)},
    {"name": "question and answer", "fields": ((LOSS_ROLE, ("answer",)),), "before": (("user", ("context?", "question")),)},
    {"name": "nested prompt", "fields": ((LOSS_ROLE, ("response.text",)),), "before": (("user", ("prompt.text",)),)},
)
SYSTEM = "system"  # a top-level field that any mapping may find


def paths(value: object, at: str = "") -> set[str]:
    """All nested field paths of a parsed JSON value that end in a plain value or null."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items()), set())
    if isinstance(value, list):
        return set().union(*(paths(v, f"{at}[]") for v in value), set())
    return {at}


def fingerprint(found: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


def _needs(m: dict) -> tuple[set[str], set[str]]:
    """The paths that a mapping requires and those it may find."""
    if "list" in m:
        inner = [m["role"], m["text"], *m.get("order", ())] + ([m["parts"]] if "parts" in m else [])
        return {f"{m['list']}[].{f}" for f in inner}, {SYSTEM}
    names = [f for _, fields in (*m["before"], *m["fields"]) for f in fields]
    return {f for f in names if not f.endswith("?")}, {f[:-1] for f in names if f.endswith("?")} | {SYSTEM}


def registry(mappings: tuple[dict, ...] = MAPPINGS) -> list[tuple[dict, frozenset[str], frozenset[str]]]:
    """(mapping, the paths that it knows, its schema fingerprints), those that require most first."""
    out = []
    for m in sorted(mappings, key=lambda m: -len(_needs(m)[0])):
        need, may = _needs(m)
        some = (set(c) for n in range(len(may) + 1) for c in combinations(sorted(may), n))
        out.append((m, frozenset(need | may), frozenset(fingerprint(need | s) for s in some)))
    return out


def select(found: set[str], table: list[tuple[dict, frozenset[str], frozenset[str]]]) -> tuple[str, dict | None, list[str]]:
    """(fingerprint, mapping, unused known paths) for a record's paths; without a mapping, the fingerprint of all known paths."""
    known = found & frozenset().union(*(paths for _, paths, _ in table))
    for m, own, prints in table:
        fp = fingerprint(found & own)
        if fp in prints:
            return fp, m, sorted(known - own)
    return fingerprint(known), None, sorted(known)


def _at(value: object, path: str) -> str:
    """The text at a path; items of an array are joined by line breaks."""
    for k, name in enumerate(path.split(".")):
        many = name.endswith("[]")
        value = value.get(name.removesuffix("[]")) if isinstance(value, dict) else None
        if many:
            rest = ".".join(path.split(".")[k + 1:])
            return "\n".join(_at(v, rest) for v in value or [])
    return "" if value is None or value == [] else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _sort_key(item: dict, order: tuple[str, ...]) -> tuple:
    return tuple((item.get(f) is not None, item.get(f) if item.get(f) is not None else 0) for f in order)


def turns(record: dict, m: dict) -> list[dict[str, str]]:
    """Canonical turns of a record under its mapping."""
    out = []
    if record.get(SYSTEM):
        out.append({"role": SYSTEM, "text": _at(record, SYSTEM)})
    if "list" in m:
        items = [x for x in record[m["list"]] if isinstance(x, dict)]
        if "order" in m:
            items.sort(key=lambda x: _sort_key(x, m["order"]))
        for x in items:
            role = _at(x, m["role"])
            split = "parts" in m and isinstance(x.get(m["text"]), list)
            out.append({"role": m.get("rename", {}).get(role, role), "text": _at(x, m["parts"] if split else m["text"])})
        return out
    for role, fields in (*m["before"], *m["fields"]):
        parts = [_at(record, f.removesuffix("?")) for f in fields]
        out.append({"role": role, "text": "\n\n".join(p for p, f in zip(parts, fields) if p or not f.endswith("?"))})
    return out


def canonical(df: DataFrame, json_col: str, mappings: tuple[dict, ...] = MAPPINGS) -> DataFrame:
    """Append ``schema_fp``, ``layout`` (null if unknown), ``turns`` and ``unused`` of each JSON record."""

    def run(rows: list) -> list[list]:
        table = registry(mappings)
        made = []
        for text in rows:
            try:
                record = json.loads(text) if text else None
            except ValueError:
                record = None
            if not isinstance(record, dict):
                made.append((None, None, [], []))
                continue
            fp, m, unused = select(paths(record), table)
            made.append((fp, m and m["name"], turns(record, m) if m else [], unused))
        return [list(c) for c in zip(*made)] or [[], [], [], []]

    return add_columns(df, json_col, "schema_fp string, layout string, turns array<struct<role: string, text: string>>, unused array<string>", run)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(items: list[dict[str, str]]) -> tuple[str, list[dict[str, int]]]:
    """The formatted conversation and its loss mask (code point spans)."""
    out, spans, at = [], [], 0
    for t in items:
        head, body = f"{START}{escape_role(t['role'])}\n", escape(t["text"])
        if t["role"] == LOSS_ROLE:
            spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
        out.append(f"{head}{body}{END}\n")
        at += len(out[-1])
    return "".join(out), spans


def parse(formatted: str) -> list[dict[str, str]]:
    """The turns that a formatted conversation holds."""
    out = []
    for part in formatted.split(START)[1:]:
        role, _, rest = part.partition("\n")
        out.append({"role": unescape_role(role), "text": unescape(rest[:rest.index(END)])})
    return out


def formatted(df: DataFrame, turns_col: str = "turns") -> DataFrame:
    """Append ``formatted`` and ``loss_spans``."""

    def run(rows: list) -> list[list]:
        made = [render(r or []) for r in rows]
        return [[m[0] for m in made], [m[1] for m in made]]

    return add_columns(df, turns_col, "formatted string, loss_spans array<struct<start: int, end: int>>", run)


def read_back(df: DataFrame) -> DataFrame:
    """Append ``read_turns`` and ``loss_text`` (unescaped), read from ``formatted`` and ``loss_spans``."""

    def run(rows: list) -> list[list]:
        return [[parse(r["formatted"]) for r in rows],
                ["".join(unescape(r["formatted"][s["start"]:s["end"]]) for s in r["loss_spans"]) for r in rows]]

    both = fresh(df, "formatted_spans")
    df = df.withColumn(both, F.struct("formatted", "loss_spans"))
    return add_columns(df, both, "read_turns array<struct<role: string, text: string>>, loss_text string", run).drop(both)


def from_turn_rows(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, record): conversations stored as one row per turn, as JSON records in the layout "turn rows"."""
    items = F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    made = df.groupBy(id_col).agg(items.alias("turns"))
    return made.select(id_col, F.to_json(F.struct("turns"), {"ignoreNullFields": "false"}).alias("record"))
