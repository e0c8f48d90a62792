"""License scans: one Aho-Corasick pass over normalised words, and a parser of licence expressions.

One automaton finds notice phrases, licence identifiers and identifier tags in a single pass over each
whole text. What follows a tag on its line goes through a shunting-yard parser, whose operands are known
identifiers alone; ``or`` is a choice, ``and`` a sum of duties and ``with`` an exception to its left side.
Prose behind an expression ends it. An identifier of one plain word counts behind a tag only.

Defined results: a null or empty text has no words, no labels and score 0; texts of any length are
scanned whole; a malformed expression yields the known identifiers that it begins with and no verdict; a tag without any
yields nothing; extra columns are ignored; repeated rows give repeated results.
"""

from __future__ import annotations

import re
from functools import cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm._common import map_texts, table
from strideframe.llm.words import alnum_words

#: Fixed values of the query's contract: phrase words and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notice phrases that the method adds.
NOTICES = {
    "apache license": "apache",
    "bsd license": "bsd",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "cc0": "cc0",
    "eclipse public license": "epl",
    "isc license": "isc",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "public domain": "public-domain",
    "unlicense": "unlicense",
    "without warranties or conditions of any kind": "apache",
}
#: Identifiers of the public licence list, and whether they allow reuse with notice alone.
PERMISSIVE = """0bsd afl-3.0 apache-1.1 apache-2.0 artistic-2.0 bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-4-clause
bsl-1.0 cc-by-3.0 cc-by-4.0 cc0-1.0 ecl-2.0 isc mit mit-0 mulanpsl-2.0 ncsa ofl-1.1 pddl-1.0 postgresql python-2.0 unicode-dfs-2016 unlicense upl-1.0
wtfpl x11 zlib""".split()
RESTRICTED = """agpl-3.0 agpl-3.0-only agpl-3.0-or-later bsd-3-clause-no-nuclear-license busl-1.1 cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-nd-3.0 cc-by-nc-nd-4.0
cc-by-nc-sa-3.0 cc-by-nc-sa-4.0 cc-by-nd-3.0 cc-by-nd-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cddl-1.0 cddl-1.1 cecill-2.1 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2
gfdl-1.3 gpl-1.0 gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later lgpl-2.0 lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later
lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later mpl-1.1 mpl-2.0 ms-rl odbl-1.0 osl-3.0 rpl-1.5 sspl-1.0""".split()
EXCEPTIONS = """autoconf-exception-3.0 bison-exception-2.2 classpath-exception-2.0 font-exception-2.0 gcc-exception-2.0 gcc-exception-3.1
linux-syscall-note llvm-exception openssl-exception""".split()
IDENTIFIERS = frozenset(PERMISSIVE + RESTRICTED)
TAG = "spdx license identifier"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[()]|[a-z0-9](?:[a-z0-9.\-]*[a-z0-9])?\+?")
#: Evidence of a single finding; a tag that parses says most.
WEIGHT = {"tag": 0.95, "notice": 0.8, "base": 0.6}
PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def operand(token: str, exception: bool = False) -> str | None:
    """The known identifier that a token is; a plus behind it means later versions as well."""
    name = token.rstrip("+")
    return name if name in (EXCEPTIONS if exception else IDENTIFIERS) else None


def to_postfix(expression: str) -> tuple[list[str] | None, list[str]]:
    """Shunting-yard: operands and operators in postfix order, None if malformed; and the known identifiers that were read."""
    out: list[str] = []
    held: list[str] = []
    seen: list[str] = []
    want_operand = True
    for token in TOKEN.findall(expression.lower()):
        if token in PRECEDENCE:
            if want_operand:
                return None, seen
            while held and held[-1] != "(" and PRECEDENCE[held[-1]] >= PRECEDENCE[token]:
                out.append(held.pop())
            held.append(token)
            want_operand = True
        elif token == "(":
            if not want_operand:
                break
            held.append(token)
        elif token == ")":
            if want_operand:
                return None, seen
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                break  # a bracket of the prose around it
            held.pop()
        else:
            name = operand(token, bool(held) and held[-1] == "with") if want_operand else None
            if name is None:
                break  # the expression has ended; prose follows
            out.append(name)
            seen.append(name)
            want_operand = False
    if want_operand or "(" in held:
        return None, seen
    return out + held[::-1], seen


def evaluate(postfix: list[str]) -> bool:
    """Whether some choice of the expression leaves permissive terms only."""
    stack: list[bool] = []
    for token in postfix:
        if token in PRECEDENCE:
            right, left = stack.pop(), stack.pop()
            stack.append(left or right if token == "or" else left if token == "with" else left and right)
        else:
            stack.append(token in PERMISSIVE)
    return stack[0]


def spelled(name: str) -> str:
    """An identifier as the words that it is split into."""
    return re.sub(r"[^a-z0-9]+", " ", name)


@cache
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    plain = {spelled(i): i for i in IDENTIFIERS if " " in spelled(i)}
    for phrase in {**NOTICES, **BASE, **plain, TAG: TAG}:
        found.add_word(f" {phrase} ", (phrase, plain.get(phrase)))
    found.make_automaton()
    return found


def behind_tag(text: str, word: int) -> str:
    """What follows a tag, whose first word has this number, on its line."""
    end = next(islice(WORD.finditer(text), word + 2, None)).end()
    return text[end:].split("\n", 1)[0].split("\r", 1)[0].lstrip(" \t:")


def scan(text: str | None) -> dict:
    """Everything the operator finds in one text."""
    words = alnum_words(text)
    joined = b" ".join([b"", *words, b""]).decode("utf-8", "replace")
    starts: list[int] = []
    base: set[str] = set()
    kinds: dict[str, float] = {}
    expressions: list[str] = []
    permissive: bool | None = None

    def add(label: str, kind: str) -> None:
        kinds[label] = max(kinds.get(label, 0), WEIGHT[kind])

    at = seen = past = 0
    # from the left; of those with one begin the longest first
    hits = sorted((end - len(phrase) - 1, -len(phrase), phrase, name) for end, (phrase, name) in automaton().iter(joined))
    for begin, length, phrase, name in hits:
        seen += joined.count(" ", at, begin)
        at = begin
        if phrase in BASE:
            starts.append(seen)
            base.add(BASE[phrase])
            add(BASE[phrase], "base")
        if phrase in NOTICES:
            add(NOTICES[phrase], "notice")
        if name and begin >= past:  # not within a longer identifier
            past = begin - length
            add(name, "notice")
        if phrase == TAG:
            expression = behind_tag(text, seen)
            postfix, names = to_postfix(expression)
            for label in names:
                if label in IDENTIFIERS:
                    add(label, "tag" if postfix else "base")
            if names:
                expressions.append(expression.strip())
            if postfix:
                permissive = evaluate(postfix) if permissive is None else permissive and evaluate(postfix)
    doubt = 1.0
    for label in sorted(kinds):
        doubt *= 1 - kinds[label]
    return {
        "n_words": len(words),
        "n_base": len(starts),
        "first_word": starts[0] if starts else None,
        "last_word": starts[-1] if starts else None,
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(kinds)),
        "score": 1 - doubt,
        "permissive": permissive,
        "expressions": expressions,
    }


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row of findings for each row of (doc_id, text)."""
    kinds = pa.schema(
        [
            ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
            ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("permissive", pa.bool_()), ("expressions", pa.list_(pa.string())),
        ]
    )

    def rows():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = [{"doc_id": d} | scan(t) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())]
            return pa.RecordBatch.from_pylist(got, schema=kinds)

        return step

    return map_texts(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"),
        rows,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean, expressions array<string>",
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License findings of every whole text of documents."""
    return scan_licenses(table(spark, sf_dir, "documents"))
