"""Cut TypeScript and Go files into declaration chunks, without a grammar.

Each file is read once, where its row is: its lexemes pass a stack of open brackets, and
what can begin, end or belong to a declaration is kept with the braces that enclose it.
When the braces close, one look back over what they hold gives each declaration its end.
Nothing is kept per lexeme but its place, no row leaves its task, and there is no shuffle.

Every row is a file: one that is repeated is cut as often, as in ``chunk_documents``.

Known limits: a decorator is part of a class or export only when it stands on
lines of its own before it; template strings that nest a backtick, and apostrophes or
unbalanced brackets in JSX text, can shift a boundary.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.operators.chunking import chunk_nodes
from corpusmill.schema import CHUNK_MAX_CHARS, CHUNK_MIN_CHARS

# A match is one significant lexeme (the group) with the blanks and comments before it.
# Every part is possessive, so the matcher does not backtrack on long strings and comments.
_BLANK = r"[ \t\n\x0b\f\r]"
_LEAD = rf"(?:{_BLANK}++|//[^\n]*+|/\*(?:[^*]|\*(?!/))*+(?:\*/)?)"
_STRINGS = [r'"(?:[^"\\\n]|\\[\s\S])*+"?', r"'(?:[^'\\\n]|\\[\s\S])*+'?"]
_TEMPLATE = r"`(?:[^`\\]|\\[\s\S])*+`?"
_RAW_STRING = r"`[^`]*+`?"
# A slash begins a pattern after one of these and at most eight blanks.
_BEFORE_REGEX = "|".join(
    rf"(?<={before}{_BLANK * n})" for n in range(9) for before in (r"[(=,:;!&|?{\[]", "=>", r"\breturn"))
_REGEX = rf"(?=/)(?:{_BEFORE_REGEX})/(?![/*])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*+"
_REST = [r"[\w$]++", r"=>", r"[=!<>]=++", r"[^ \t\n\x0b\f\r]"]
_LEXEMES = {
    "typescript": re.compile(rf"{_LEAD}*+({'|'.join([*_STRINGS, _TEMPLATE, _REGEX, *_REST])})|{_LEAD}++"),
    "go": re.compile(rf"{_LEAD}*+({'|'.join([*_STRINGS, _RAW_STRING, *_REST])})|{_LEAD}++"),
}

# A newline does not end a statement after one of these ...
_OPEN_ENDED = frozenset([
    "=", "=>", "|", "&", "?", ":", ",", "+", "-", "*", "/", "%", "<", ".", "!", "~",
    "==", "===", "!=", "!==", "<=", ">=", "extends", "implements", "keyof", "typeof",
    "new", "in", "of", "instanceof", "as", "satisfies", "is", "async", "export",
    "default", "declare", "abstract", "const", "let", "var", "function", "class",
    "interface", "enum", "namespace", "type", "readonly", "infer",
])
# ... nor before one of these.
_CONTINUING = frozenset([
    ".", ",", ";", "|", "&", "?", ":", "=", "=>", "+", "-", "*", "/", "%", "<", ">",
    "(", "[", "{", "==", "===", "!=", "!==", "<=", ">=", "extends", "implements",
    "in", "of", "instanceof", "as", "satisfies", "is",
])
_AFTER_TYPE_BRACE = frozenset(["{", "|", "&", ">", "["])
_BLOCK_KINDS = frozenset(["function", "class", "interface", "enum", "namespace", "module", "abstract"])
_MODIFIERS = frozenset([
    "public", "private", "protected", "static", "override", "readonly", "async", "get", "set", "*",
])
_WORDS = frozenset(["@", "class", "interface", "type", "export", "const", "let", "var", "func"])
_NOT_METHODS = frozenset([
    "if", "for", "while", "switch", "catch", "with", "function", "return", "await",
    "new", "typeof", "import", "super",
])
_OPENS, _CLOSES = frozenset("([{"), frozenset(")]}")
_MARKS = frozenset([*_OPENS, *_CLOSES, ";", ",", "=>", "=", "function"])
_SPLITS = frozenset(["{", "}", ";", ","])
_PREFIXES = frozenset(["export", "default", "declare"])
_GO_ENDS = frozenset("_)]}\"'`")
_OUTPUT = "filepath string, language string, node_type string, start_line int, code string"
#: Bytes of nodes that leave a task at a time.
_OUTPUT_BYTES = 4 << 20

Node = tuple[str, int, str]  # kind, first line, code
Hit = tuple[str, int, int, int]  # kind, first and last lexeme, line


def _word(lexeme: str) -> bool:
    return lexeme[:1].isalpha() or lexeme[:1] in ("_", "$")


class _Lexemes:
    """The lexemes of a file: text, place and lines, and where statements and members begin."""

    def __init__(self, code: str, language: str):
        self.go = language == "go"
        self.text: list[str] = []
        self.place: list[int] = []
        self.line: list[int] = []
        self.end_line: list[int] = []
        line = 1
        for match in _LEXEMES[language].finditer(code):
            start, stop = match.span(1)
            if start < 0:  # blanks and comments at the end
                break
            line += code.count("\n", match.start(), start)
            self.text.append(match[1])
            self.place.append(start)
            self.line.append(line)
            if "\n" in match[1]:
                line += code.count("\n", start, stop)
            self.end_line.append(line)
        self.text += ["", "", ""]  # what follows the last one
        self.size = len(self.place)

    def breaks(self, k: int) -> bool:
        """A line end before this lexeme ends a statement."""
        if not k or self.line[k] <= self.end_line[k - 1] or self.text[k] in _CLOSES:
            return False
        before, lexeme = self.text[k - 1], self.text[k]
        if self.go:
            return before[-1].isalnum() or before[-1] in _GO_ENDS
        return before not in _OPEN_ENDED and lexeme not in _CONTINUING and lexeme[0] != "`"

    def starts(self, k: int) -> bool:
        """A statement begins here."""
        if not k or self.text[k - 1] in _PREFIXES or self.breaks(k):
            return True
        return self.text[k - 1] in (";", "{", "}") and self.text[k] not in _CLOSES and self.text[k] not in _CONTINUING

    def member(self, k: int) -> bool:
        """A member of a class or object begins here."""
        return k > 0 and (self.text[k - 1] in _SPLITS or self.breaks(k))


class _Block:
    """What braces hold: the lexemes that matter, and the one that closes them."""

    __slots__ = ("level", "brace", "held", "closed")

    def __init__(self, level: int, brace: bool):
        self.level, self.brace = level, brace
        self.held: list[int] = []
        self.closed: int | None = None


def _blocks(lexemes: _Lexemes) -> Iterator[_Block]:
    """One pass with a stack of open brackets; braces come out as they close, the rest at the end."""
    text, top = lexemes.text, _Block(0, True)
    stack = [top]
    for k in range(lexemes.size):
        lexeme = text[k]
        if lexeme in _CLOSES and len(stack) > 1:
            done = stack.pop()
            done.closed = k
            if done.brace and done.held:
                yield done
        block = stack[-1]
        if block.brace and (
                lexeme in _MARKS or text[k + 1] == "(" and _word(lexeme) or lexemes.breaks(k)
                or lexeme in _WORDS and lexemes.starts(k)):
            block.held.append(k)
        if lexeme in _OPENS:
            stack.append(_Block(block.level + 1, lexeme == "{"))
    yield from (block for block in reversed(stack) if block.brace and block.held)


class _Ahead:
    """The nearest lexemes behind a place in its block: what may end a declaration there."""

    __slots__ = ("semi", "comma", "line_end", "body_end", "brace", "paren", "arrow_end", "stop")

    def __init__(self, last: int):
        self.semi = self.comma = self.line_end = self.body_end = self.brace = self.paren = self.arrow_end = None
        self.stop = last

    def copy(self) -> _Ahead:
        other = _Ahead(self.stop)
        for name in _Ahead.__slots__:
            setattr(other, name, getattr(self, name))
        return other

    @property
    def broken(self) -> int:
        return self.stop if self.line_end is None else min(self.line_end, self.stop)

    @property
    def statement_end(self) -> int:
        return self.broken if self.semi is None else min(self.semi, self.broken)

    @property
    def expression_end(self) -> int:
        return min(x for x in (self.broken, self.semi and self.semi - 1, self.comma) if x is not None)

    @property
    def whole_body(self) -> bool:
        return self.body_end is not None and self.body_end <= self.statement_end


def _looks_ahead(block: _Block, lexemes: _Lexemes, wanted: set[int]) -> dict[int, _Ahead]:
    """For each wanted lexeme of a block, what is behind it; one pass from the end."""
    text, ahead = lexemes.text, _Ahead(lexemes.size - 1 if block.closed is None else block.closed - 1)
    found = {}
    for k in reversed(block.held):
        lexeme, following = text[k], text[k + 1]
        if k in wanted:
            found[k] = ahead.copy()
        if lexeme == ";":
            ahead.semi = k
        elif lexeme == ",":
            ahead.comma = k - 1
        elif lexeme == ")":
            ahead.paren = k
        elif lexeme == "=>":
            end = ahead.brace if following == "{" else ahead.expression_end
            ahead.arrow_end = ahead.arrow_end if end is None else end
        elif lexeme == "}":
            ahead.brace = k
            fresh = k + 1 < lexemes.size and lexemes.line[k + 1] > lexemes.end_line[k]
            if not following or following not in _AFTER_TYPE_BRACE or fresh and following != "{":
                ahead.body_end = k
        if lexemes.breaks(k):
            ahead.line_end = k - 1
    return found


def _go_hits(block: _Block, lexemes: _Lexemes) -> Iterator[Hit]:
    text = lexemes.text
    wanted = {k for k in block.held if text[k] in ("func", "type") and lexemes.starts(k)}
    for k, ahead in _looks_ahead(block, lexemes, wanted).items():
        following, kind = text[k + 1], None
        if text[k] == "type":
            kind = "type_declaration" if _word(following) or following == "(" else None
        elif block.level == 0 and _word(following):
            kind = "function_declaration"
        elif block.level == 0 and following == "(" and ahead.paren is not None and _word(text[ahead.paren + 1]):
            kind = "method_declaration"
        if kind:
            yield kind, k, ahead.broken if ahead.semi is None else min(ahead.semi - 1, ahead.broken), lexemes.line[k]


def _ts_hits(block: _Block, lexemes: _Lexemes) -> Iterator[Hit]:
    text, line = lexemes.text, lexemes.line
    word = word_at = equals = comma = lead = None  # statement's first word, last "=", last ",", first decorator
    wanted: dict[int, tuple] = {}
    for k in block.held:
        lexeme, following = text[k], text[k + 1]
        starts, before = lexemes.starts(k), word
        if starts:
            word, word_at = lexeme, k
            if lexeme == "@" and before != "@":
                lead = k
        if lexeme == "=":
            # One "=" gives a declarator its value: the first since the statement or the last comma began.
            first = equals is None or equals < word_at if word_at is not None else True
            if word in ("const", "let", "var") and (first or comma is not None and comma > equals):
                wanted[k] = ("arrow",)
            equals = k
        elif lexeme == ",":
            comma = k
        elif lexeme == "function":
            wanted[k] = ("function", starts)
        elif lexeme in ("class", "interface", "type", "export") and starts:
            wanted[k] = (lexeme, lead if before == "@" and lexemes.breaks(k) else k)
        if k not in wanted and following == "(" and block.level and _word(lexeme) and lexeme not in _NOT_METHODS:
            wanted[k] = ("method",)
    for k, ahead in _looks_ahead(block, lexemes, set(wanted)).items():
        what, *more = wanted[k]
        hit = None
        one, two, three = text[k + 1], text[k + 2], text[k + 3] if k + 3 < len(text) else ""
        if what == "function":
            held = k > 0 and text[k - 1] == "async"
            begins = lexemes.starts(k - 1) if held else more[0]
            if begins and ahead.whole_body and (_word(one) or one == "*" and _word(two)):
                hit = "function_declaration", k - held, ahead.body_end
        elif what in ("class", "interface"):
            if ahead.whole_body and _word(one) and one not in ("extends", "implements"):
                hit = f"{what}_declaration", more[0], ahead.body_end
        elif what == "type":
            if _word(one) and two in ("=", "<"):
                hit = "type_alias_declaration", k, ahead.statement_end
        elif what == "export":
            if one not in (":", ",", "}", "(", "?", ".", ""):
                body = (
                    one in _BLOCK_KINDS or one in ("default", "declare") and two in _BLOCK_KINDS
                    or one == "async" and two == "function" or one == "const" and two == "enum"
                    or one == "default" and two == "async" and three == "function")
                end = ahead.statement_end
                hit = "export_statement", more[0], min(end, ahead.body_end) if body and ahead.body_end is not None else end
        elif what == "arrow":
            direct = _word(one) and two == "=>" or one == "async" and _word(two) and three == "=>"
            listed = (
                (one in ("(", "<") or one == "async" and two in ("(", "<"))
                and ahead.paren is not None and text[ahead.paren + 1] in ("=>", ":") and ahead.paren < ahead.statement_end)
            if (direct or listed) and ahead.arrow_end is not None:
                hit = "arrow_function", k + 1, ahead.arrow_end
        else:
            closing = text[ahead.paren + 1] if ahead.paren is not None else ""
            first = _method_start(k, lexemes)
            if first is not None and (closing == "{" or closing == ":" and ahead.whole_body):
                end = ahead.brace if closing == "{" else ahead.body_end
                hit = ("method_definition", first, end) if end is not None else None
        if hit:
            yield *hit, line[hit[1]]


def _method_start(k: int, lexemes: _Lexemes) -> int | None:
    """Where a method begins, with up to three modifiers before its name."""
    text, count = lexemes.text, 0
    while count < 3 and k > count and text[k - 1 - count] in _MODIFIERS:
        count += 1
    return next((k - n for n in range(count, -1, -1) if lexemes.member(k - n)), None)


def declarations(code: str, language: str) -> Iterator[Node]:
    """The declarations of a file in order; one inside another is left out, except inside an export."""
    lexemes = _Lexemes(code, language)
    find = _go_hits if lexemes.go else _ts_hits
    hits = sorted((h for b in _blocks(lexemes) for h in find(b, lexemes) if h[2] >= h[1]), key=lambda h: (h[1], -h[2]))
    covered = -1
    for kind, first, last, line in hits:
        if covered < first:
            yield kind, line, code[lexemes.place[first]:lexemes.place[last] + len(lexemes.text[last])]
        if kind != "export_statement":
            covered = max(covered, last)


def declaration_nodes(files: DataFrame) -> DataFrame:
    """Nodes (filepath, language, node_type, start_line, code) of all files.

    A null content or language gives none; so does a language without a set of lexemes.
    """

    def task(batches):
        rows, size = [], 0
        for batch in batches:
            for path, language, code in zip(*(batch.column(k) for k in range(3)), strict=True):
                for node in declarations(code.as_py(), language.as_py()):
                    rows.append((path.as_py(), language.as_py(), *node))
                    size += len(node[2])
                    if size >= _OUTPUT_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
        yield _batch(rows)

    known = files.where(F.col("content").isNotNull() & F.col("language").isin(*_LEXEMES)).select(
        tx.normalize_path(F.col("filepath")).alias("filepath"), "language", F.col("content").alias("code"))
    return known.mapInArrow(task, _OUTPUT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
    names = ["filepath", "language", "node_type", "start_line", "code"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def chunk_code(
    files: DataFrame,
    max_chars: int = CHUNK_MAX_CHARS,
    min_chars: int = CHUNK_MIN_CHARS,
) -> DataFrame:
    """Declaration chunks of TypeScript and Go files."""
    return chunk_nodes(declaration_nodes(files), max_chars, min_chars)
