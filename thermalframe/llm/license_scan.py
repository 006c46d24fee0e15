"""Licence scans: an Aho-Corasick automaton over words and tags, and SPDX expressions by shunting-yard.

Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters. One automaton finds notice phrases
as whole words, another the identifier tag in the text itself. What follows a tag on its line is an expression of
licence identifiers with ``and``, ``or``, ``with`` and brackets; operators go through a stack in the order with, and,
or, and the result is evaluated: its identifiers become labels, and it is permissive if it can be met by permissive
licences alone. An expression that cannot be parsed, or that has a word that is no known identifier, gives no label; it ends before
the next tag at the latest, so the work is in proportion to the text.

``score`` is 1 for a valid expression, 0.9 for a notice with a version or variant, 0.6 for a plain licence name, else 0; the
highest counts. Null and empty texts have no words, no labels and score 0. Every row is scanned by itself; only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from thermalframe.llm import text as X

#: Phrases that count as places, and their labels.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notices: words, label.
NOTICES = {
    "apache license version 2 0": "apache-2.0", "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0", "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl", "mozilla public license": "mpl", "bsd license": "bsd", "isc license": "isc",
    "eclipse public license": "epl", "boost software license": "bsl", "cc by 4 0": "cc-by-4.0", "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd", "cc0": "cc0",
    "creative commons attribution": "cc-by", "public domain": "public-domain", "all rights reserved": "all-rights-reserved",
}
PLAIN = {"bsd", "isc", "lgpl", "agpl", "mpl", "epl", "bsl", "cc0", "public-domain", "all-rights-reserved"}
TAG = "spdx-license-identifier:"
#: Identifiers by family: versions of each; a family's identifier is ``family-version``.
VERSIONS = {
    "gpl": "1.0 2.0 3.0", "lgpl": "2.0 2.1 3.0", "agpl": "1.0 3.0", "gfdl": "1.1 1.2 1.3", "apache": "1.0 1.1 2.0", "mpl": "1.0 1.1 2.0",
    "epl": "1.0 2.0", "cpl": "1.0", "cddl": "1.0 1.1", "eupl": "1.0 1.1 1.2", "artistic": "1.0 2.0", "afl": "1.1 1.2 2.0 2.1 3.0",
    "osl": "1.0 1.1 2.0 2.1 3.0", "bsl": "1.0", "cecill": "1.0 1.1 2.0 2.1", "cc0": "1.0", "python": "2.0", "psf": "2.0", "ofl": "1.0 1.1",
    "zpl": "1.1 2.0 2.1", "upl": "1.0", "php": "3.0 3.01", "ecl": "1.0 2.0", "odbl": "1.0", "odc-by": "1.0", "pddl": "1.0", "blueoak": "1.0.0",
    "lppl": "1.0 1.1 1.2 1.3a 1.3c", "ms": "pl rl", "bsd": "1-clause 2-clause 3-clause 4-clause 2-clause-patent 3-clause-clear",
    "unicode": "3.0 dfs-2015 dfs-2016", "busl": "1.1", "sspl": "1.0", "elastic": "2.0", "mulanpsl": "1.0 2.0", "ncgl-uk": "2.0", "ogl-uk": "1.0 2.0 3.0",
    **{f"cc-by{x}": "1.0 2.0 2.5 3.0 4.0" for x in ("", "-sa", "-nc", "-nd", "-nc-sa", "-nc-nd")},
}
#: Identifiers without a version.
UNVERSIONED = frozenset("mit mit-0 mit-cmu isc zlib unlicense 0bsd x11 ncsa wtfpl postgresql openssl curl libpng libpng-2.0 ruby vim w3c hpnd icu "
                        "ijg json sleepycat tcl fsfap ftl beerware".split())
#: Exceptions that may follow ``with``.
EXCEPTIONS = frozenset(
    "classpath-exception-2.0 llvm-exception gcc-exception-2.0 gcc-exception-3.1 bison-exception-2.2 autoconf-exception-2.0 "
    "autoconf-exception-3.0 font-exception-2.0 linux-syscall-note openvpn-openssl-exception u-boot-exception-2.0 wxwindows-exception-3.1 "
    "swift-exception libtool-exception ocaml-lgpl-linking-exception qt-gpl-exception-1.0 qt-lgpl-exception-1.1 openjdk-assembly-exception-1.0 "
    "gpl-3.0-linking-exception lgpl-3.0-linking-exception ecos-exception-2.0 freertos-exception-2.0 mif-exception nokia-qt-exception-1.1 "
    "bootloader-exception cryptsetup-openssl-exception universal-foss-exception-1.0".split())
PERMISSIVE = ("mit", "apache", "bsd", "isc", "bsl", "zlib", "unlicense", "cc0", "cc-by-3", "cc-by-4", "0bsd", "python", "psf")
RANK = {"or": 1, "and": 2, "with": 3}

_word_bytes = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_lower_bytes = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_token = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")


class BadExpression(ValueError):
    pass


def known(identifier: str) -> bool:
    """Whether a lower-case word is a licence identifier: a listed one, its ``+``, ``-only`` or ``-or-later`` form, or a custom reference."""
    if identifier.startswith(("licenseref-", "documentref-")):
        return True
    plain = identifier.removesuffix("+").removesuffix("-only").removesuffix("-or-later")
    if plain in UNVERSIONED:
        return identifier == plain
    family, _, version = plain.partition("-")
    while family not in VERSIONS or version not in VERSIONS[family].split():
        more, _, version = version.partition("-")
        if not version:
            return False
        family += "-" + more
    return True


def postfix(expression: str) -> list[str]:
    """Identifiers and operators in postfix order."""
    out: list[str] = []
    stack: list[str] = []
    operand = True                                    # an operand comes next
    for token in _token.findall(expression.lower()):
        if token in RANK:
            if operand:
                raise BadExpression(expression)
            while stack and stack[-1] != "(" and RANK[stack[-1]] >= RANK[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = True
        elif token == "(":
            if not operand:
                raise BadExpression(expression)
            stack.append(token)
        elif token == ")":
            if operand:
                raise BadExpression(expression)
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise BadExpression(expression)
            stack.pop()
        else:
            if not operand:
                raise BadExpression(expression)
            out.append(token)
            operand = False
    if operand or "(" in stack:
        raise BadExpression(expression)
    return out + stack[::-1]


def evaluate(expression: str) -> tuple[set[str], bool]:
    """Labels of an expression, and whether permissive licences alone can meet it."""
    stack: list[tuple[set[str], bool, bool]] = []     # labels, permissive, a single licence
    for token in postfix(expression):
        if token not in RANK:
            if not known(token) and token not in EXCEPTIONS:
                raise BadExpression(expression)
            stack.append(({token}, token.startswith(PERMISSIVE), True))
            continue
        (right, free_right, one_right), (left, free_left, one_left) = stack.pop(), stack.pop()
        if token == "with":
            if not (one_left and one_right) or min(right) not in EXCEPTIONS or min(left) in EXCEPTIONS:
                raise BadExpression(expression)
            stack.append(({f"{min(left)} with {min(right)}"}, free_left, False))
        else:
            free = free_left and free_right if token == "and" else free_left or free_right
            stack.append((left | right, free, False))
        if token != "with" and (left | right) & EXCEPTIONS:
            raise BadExpression(expression)
    labels, free, _ = stack.pop()
    if labels & EXCEPTIONS:
        raise BadExpression(expression)
    return labels, free


_part = re.compile(r"\s*+(?:(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*+)|\S?)")


def expression_after(text: str, at: int = 0, limit: int | None = None) -> str:
    """What may belong to an expression from a position to the end of its line or to ``limit``, as far as it goes.

    Nothing is cut or copied: the walk stops at the first part that does not fit.
    """
    limit = len(text) if limit is None else limit
    end = text.find("\n", at, limit)
    tokens, depth, operand = [], 0, True
    for m in _part.finditer(text, at, limit if end < 0 else end):
        token = m[1]
        if token is None:
            break
        low = token.lower()
        if operand:
            if low == "(":
                depth += 1
            elif low == ")" or low in RANK:
                break
            else:
                operand = False
        elif low in RANK:
            operand = True
        elif low == ")" and depth:
            depth -= 1
        else:
            break
        tokens.append(token.rstrip(".:") if low not in "()" else token)
    return " ".join(tokens)


def automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase in {**BASE_PHRASES, **NOTICES}:
        phrases.add_word(f" {phrase} ", phrase)
    tags.add_word(TAG, TAG)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def scan(text: bytes, phrases: ahocorasick.Automaton, tags: ahocorasick.Automaton) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, permissive of one text."""
    found = text.translate(_word_bytes).split()
    line = (b" " + b" ".join(found) + b" ").decode("latin-1")
    n_base, first, last, base, labels, score = 0, None, None, set(), set(), 0.0
    passed, before = 0, 0                             # words that ended before a position
    for end, phrase in phrases.iter(line):
        before += line.count(" ", passed, end)
        passed = end
        if phrase in BASE_PHRASES:
            at = before - phrase.count(" ") - 1
            n_base += 1
            first, last = at if first is None else min(first, at), at if last is None else max(last, at)
            base.add(BASE_PHRASES[phrase])
            score = max(score, 0.6)
        if phrase in NOTICES:
            labels.add(NOTICES[phrase])
            score = max(score, 0.6 if NOTICES[phrase] in PLAIN else 0.9)
    expressions, free = [], None
    if b":" in text:
        plain = text.decode("utf-8", "ignore")
        low = text.translate(_lower_bytes).decode("utf-8", "ignore")      # as long as ``plain``
        ends = [end + 1 for end, _ in tags.iter(low)]
        for end, following in zip(ends, [*(e - len(TAG) for e in ends[1:]), len(plain)]):        # up to the next tag
            expression = expression_after(plain, end, following)
            try:
                more, permissive = evaluate(expression)
            except BadExpression:
                continue
            labels |= more
            expressions.append(expression)
            free = permissive if free is None else free and permissive
            score = 1.0
    return (len(found), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)), score,
            ";".join(expressions), free)


SCANNED = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
           "score double, expressions string, permissive boolean")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Places, labels, expressions and score of every row; see the module's text."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, tags = automata()
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string(), pa.bool_()]
        names = [x.split()[0] for x in SCANNED.split(", ")]
        for batch in X.slices(batches):
            rows = [scan(t or b"", phrases, tags) for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()),
                                   *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names)
    return docs.select("doc_id", "text").mapInArrow(work, SCANNED)
