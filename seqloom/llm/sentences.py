"""Sentences of running text amid TeX markup, in many scripts.

A pushdown automaton reads a text once. Its alphabet is the output of one regular expression that skips everything but
marks, quotation signs, brackets, formulas, commands, comments and blank lines; its stack holds the open lists and, above them, open
quotations, brackets and braces; abbreviations are recognised backwards from a full stop by a trie. It emits code point offsets and the
list level. A sign is pushed if what closes it stands in the same paragraph, which is looked up once for all signs before it, so the time is linear.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from ..session import ship

# Abbreviations that a full stop closes without closing a sentence.
ABBREVIATIONS = """
approx. resp. w.r.t. e.g. i.e. cf. vs. Fig. Figs. No. Nos. Sec. Secs. Eq. Eqs. Thm. Lem. Prop. Cor. Def. Ch. Ref. Refs. Tab. Vol. App.
Dr. Prof. Mr. Mrs. Ms. St. Jr. Sr. al. pp. p. no. ed. eds. viz. ca. n.a. a.k.a. Ed. i.i.d. a.s. a.e. w.l.o.g. vol. fig. sec. eq.
Abb. Nr. bzw. vgl. sog. d.h. d. h. z.B. z. B. u.a. u. a. o.B.d.A. i.A. Gl. Kap. Abschn. Hr. Fr. evtl. ggf. inkl. S. Bd. Hrsg.
p. ex. c.-à-d. env. éq. fig. cf. M. MM. Mme. n. chap. sect. art. ex. av. ap. apr.
núm. ec. aprox. p. ej. pág. págs. Sra. Srta. Dra. Ud. Uds. cap. tabl. art. vs.
стр. напр. рис. см. ур. ср. т.е. т. е. г. гг. табл. гл. им. проф. акад. св. тыс. млн. др.
सं. डॉ. पृ. श्री. चि. ص. د. م. أ. ج. พ.ศ. ค.ศ. ดร. น.
""".split("\n")

# Abbreviations that may stand last in a sentence.
CLOSING_ABBREVIATIONS = ["etc.", "usw.", "usf.", "т.д.", "т. д.", "т.п.", "т. п.", "إلخ.", "u.s.w."]

# German months, which follow an ordinal number.
MONTHS = ["Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember"]

_SKIPPED_ENV = {"comment", "figure", "table", "tabular", "tabularx", "longtable", "verbatim", "lstlisting", "tikzpicture", "algorithm", "algorithmic", "wrapfigure", "sidewaystable"}
_FORMULA_ENV = {"equation", "align", "alignat", "gather", "multline", "eqnarray", "displaymath", "flalign", "math"}
_HEADINGS = {
    "part", "chapter", "section", "subsection", "subsubsection", "paragraph", "subparagraph", "title", "author", "date", "thanks", "address",
    "email", "affiliation", "keywords", "caption", "documentclass", "usepackage", "bibliographystyle", "institute",
}
_DEFINITIONS = {"def", "newcommand", "renewcommand", "providecommand", "DeclareMathOperator", "newtheorem", "let", "gdef", "edef", "newenvironment"}
_WITH_KEY = {"cite", "citep", "citet", "ref", "eqref", "pageref", "autoref", "cref", "Cref", "label", "url", "href", "nocite"}
_INLINE = _WITH_KEY - {"label", "nocite"} | {"emph", "textbf", "textit", "texttt", "textsc", "textrm", "text", "underline", "mbox", "footnote", "ldots", "dots"}
_PAIRS = {"``": "''", "«": "»", "„": "“", "“": "”", "「": "」", "『": "』", "(": ")", "（": "）", "‹": "›", "《": "》", "[": "]", "{": "}", '"': '"'}
_BRACKETS = {")", "）", "]"}
#: A sentence may end within braces, as they only group.
_GROUP = "}"
_LIST_ENV = {"itemize", "enumerate", "description", "list"}
_CLOSERS = ("''", "”", "»", "」", "』", ")", "）", "]", "}", "›", "》", '"')
_THAI = "฀-๿"

_TOKEN = re.compile(
    r"""
    (?P<comment>%[^\n]*)
  | (?P<blank>\n[ \t\r]*\n\s*)
  | (?P<display>\$\$.*?\$\$ | \\\[.*?\\\])
  | (?P<math>\$(?:[^$\\]|\\.)*\$ | \\\(.*?\\\))
  | (?P<env>\\(?:begin|end)\{[^}\n]*\})
  | (?P<command>\\[A-Za-z]+\*?)
  | (?P<escaped>\\.)
  | (?P<mark>[.?!…。？！।॥؟．]+)
  | (?P<quote>``|''|[«»„“”「」『』()（）‹›《》\[\]{}"])
  | (?P<thai>(?<=[THAI])[ \n ]+(?=[THAI]))
    """.replace("THAI", _THAI),
    re.X | re.S,
)
_NONSPACE = re.compile(r"\S")
_ARGS = re.compile(r"\s*(?:\[[^\]\n]*\])?(?:\{[^{}]*\})?")
_REST_ONLY = re.compile(r"(?:\[[^\]\n]*\])*(?:\{[^{}\n]*\})*[ \t\r]*(?=\n|%|\Z)")
_NEXT = re.compile(r"(?:\s|%[^\n]*\n|~)*")
_BEFORE_NUMBER = re.compile(r"(?:^|[^\w])\d{1,2}\Z")
_MONTH = re.compile(r"(?:\s|~)*(?:\\[a-z]+\{)?(?:%s)\b" % "|".join(MONTHS))
_NO_CASE_QUOTES = re.compile(r"[֐-ۿऀ-ॿ぀-ヿ㐀-鿿＀-￯]")


def _trie(words: list[str]) -> dict:
    """Trie of the reversed words; a blank stands for any blanks."""
    root: dict = {}
    for w in words:
        node = root
        for c in reversed(w):
            node = node.setdefault(c, {})
        node[""] = True
    return root


def _split_abbreviations() -> list[str]:
    out = []
    for line in ABBREVIATIONS:
        out += line.split()
    return [*out, "d. h.", "z. B.", "u. a.", "p. ex.", "p. ej.", "т. е."]


_OPEN_TRIE, _CLOSING_TRIE = _trie(_split_abbreviations()), _trie(CLOSING_ABBREVIATIONS)


def _wordlike(c: str) -> bool:
    return c.isalnum() or "ऀ" <= c <= "ॿ" and c not in "।॥"


def _in_trie(trie: dict, text: str, i: int, low: int, joined: bool = False) -> bool:
    """Whether a word of the trie ends with the character at i."""
    node = trie
    while i >= low:
        c = text[i]
        if c.isspace() or c == "~":
            c = " "
            while i > low and (text[i - 1].isspace() or text[i - 1] == "~"):
                i -= 1
        node = node.get(c)
        if node is None:
            return False
        i -= 1
        if "" in node and (i < low or not _wordlike(text[i]) or "฀" <= text[i] <= "๿"):
            return True
    return False


def _balanced(text: str, i: int) -> int:
    """Just behind the brace group at i, or i if there is none."""
    if i >= len(text) or text[i] != "{":
        return i
    depth = 0
    for m in re.compile(r"\\.|[{}]", re.S).finditer(text, i):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if not depth:
                return m.end()
    return len(text)


class _Next:
    """Where a string stands next at or behind a place; places may only grow, so a text is searched once for each string."""

    def __init__(self, text: str):
        self.text, self.known = text, {}

    def __call__(self, sign: str, pos: int) -> int:
        k = self.known.get(sign, -2)
        if k == -2 or -1 < k < pos:
            k = self.known[sign] = self.text.find(sign, pos)
        return k


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each sentence of a text, in order; none for a null or empty one."""
    return [(s, e) for s, e, _ in leveled_spans(text)]


def leveled_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, end, number of lists around) of each sentence of a text, in order; none for a null or empty one."""
    if not text:
        return []
    spans: list[tuple[int, int, int]] = []
    m = re.search(r"(?m)^[^%\n]*?\\begin\{document\}", text)
    pos = low = m.end() if m else 0
    n = len(text)
    start = -1  # of the open sentence, or -1
    last = pos  # end of the open sentence's content so far
    stack: list[str] = []  # what closes the open lists, then the signs that close what is open in the sentence
    level = 0  # number of lists on the stack
    scan, ahead = _TOKEN.search, _Next(text)

    def flush() -> None:
        nonlocal start
        if start >= 0 and last > start:
            spans.append((start, last, level))
        start = -1
        del stack[level:]

    while pos < n:
        m = scan(text, pos)
        at = m.start() if m else n
        if at > pos:
            first = _NONSPACE.search(text, pos, at)
            if first:
                if start < 0:
                    start = first.start()
                last = at
                while text[last - 1].isspace():
                    last -= 1
        if not m:
            break
        kind, pos = m.lastgroup, m.end()
        if kind == "comment":
            continue
        if kind == "blank":
            flush()
            continue
        if kind == "display":
            if start >= 0:
                last = pos
            continue
        if kind == "env":
            opens, name = text[at + 1] == "b", text[text.index("{", at) + 1 : pos - 1].rstrip("*")
            if name == "thebibliography" or name == "document" and not opens:
                break
            if opens and name in _FORMULA_ENV:
                k = text.find("\\end{" + text[text.index("{", at) + 1 : pos], pos)
                pos = n if k < 0 else text.index("}", k) + 1
                if start >= 0:
                    last = pos
                continue
            flush()
            if name in _LIST_ENV:
                if opens:
                    stack.append(name)
                    level += 1
                elif name in stack:  # what is left open within it ends with it
                    while stack.pop() != name:
                        pass
                    level = len(stack)
            if opens and name in _SKIPPED_ENV:
                k = text.find("\\end{" + text[text.index("{", at) + 1 : pos], pos)
                pos = n if k < 0 else text.index("}", k) + 1
            elif opens:
                pos = _ARGS.match(text, pos).end() if text[pos : pos + 1] in ("[", "{") else pos
            continue
        if kind == "command":
            name = m[0][1:].rstrip("*")
            if name == "bibliography":
                break
            if name == "iffalse":
                flush()
                k = text.find("\\fi", pos)
                pos = n if k < 0 else k + 3
                continue
            if name == "item":
                flush()
                if text[pos : pos + 1] == "[":
                    pos = _ARGS.match(text, pos).end()
                continue
            if name in _DEFINITIONS:
                flush()
                k = text.find("\n", pos)
                pos = n if k < 0 else k
                continue
            if name in _HEADINGS:
                flush()
                if text[pos : pos + 1] == "[":
                    pos = text.find("]", pos) + 1 or n
                pos = _balanced(text, pos)
                k = re.compile(r"[ \t]*\\label\{[^}]*\}").match(text, pos)
                pos = k.end() if k else pos
                continue
            k = at
            while k > low and text[k - 1] in " \t":
                k -= 1
            if name not in _INLINE and (k == low or text[k - 1] == "\n") and (rest := _REST_ONLY.match(text, pos)):
                flush()
                pos = rest.end()
                continue
            if name in _WITH_KEY:
                pos = _ARGS.match(text, pos).end()
            if start < 0:
                if name == "label":
                    continue
                start = at
            last = pos
            continue
        if kind == "math" or kind == "escaped":
            if start < 0:
                start = at
            last = pos
            continue
        if kind == "thai":
            if len(stack) == level or all(x == _GROUP for x in stack[level:]):
                flush()
            continue
        if kind == "quote":
            sign = m[0]
            if len(stack) > level and sign == stack[-1]:
                stack.pop()
                if start >= 0:
                    last = pos
                continue
            if sign in _PAIRS:
                close = _PAIRS[sign]
                k, b = ahead(close, pos), ahead("\n\n", pos)
                if k >= 0 and (b < 0 or k < b):
                    stack.append(close)
            if start < 0:
                start = at
            last = pos
            continue
        # a mark
        mark = m[0]
        if start < 0:
            start = at
        last = pos
        before = text[at - 1] if at > low else ""
        after = text[pos] if pos < n else ""
        if mark == "." or mark == "．":
            if after and (after in ",;:-" or before.isdigit() and after.isdigit() or after.islower() or after.isdigit() and _wordlike(before)):
                continue
            closing = _in_trie(_CLOSING_TRIE, text, at, low)
            if not closing:
                if _wordlike(before) and (at - 2 < low or not _wordlike(text[at - 2])) and not before.isdigit() and not _NO_CASE_QUOTES.match(before):
                    continue  # an initial
                if _in_trie(_OPEN_TRIE, text, at, low):
                    continue
                if before.isdigit() and _BEFORE_NUMBER.search(text, max(low, at - 3), at) and _MONTH.match(text, pos):
                    continue
            else:
                k = _NEXT.match(text, pos).end()
                if k < n and text[k] in ",;:":
                    continue
        quoted = bracketed = False
        end = pos
        while len(stack) > level:
            k = end
            if stack[-1] == "»" and text[k : k + 1] in (" ", "~", " "):
                k += 1
            if not text.startswith(stack[-1], k):
                break
            quoted, bracketed = quoted or stack[-1] not in _BRACKETS and stack[-1] != _GROUP, bracketed or stack[-1] in _BRACKETS
            end = k + len(stack.pop())
        if any(x != _GROUP for x in stack[level:]):
            pos = last = end
            continue
        if quoted or bracketed:
            pos = last = end
            k = _NEXT.match(text, end).end()
            follows = text[k] if k < n else ""
            if follows and (follows.islower() or follows in ",;:，；：、،") and "\n\n" not in text[end:k]:
                continue
            if quoted and _NO_CASE_QUOTES.match(text[max(low, at - 1)]):
                continue
        while True:
            for c in _CLOSERS:
                if text.startswith(c, end):
                    end += len(c)
                    break
            else:
                break
        pos = last = end
        flush()
    flush()
    return spans


def split_sentences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per sentence: ``doc_id``, ``sent_start``, ``sent_end`` (code point offsets into the text), ``level`` (lists around it).

    Null and empty texts give no row; every row of ``df`` is read whole, repeated rows give repeated sentences; other
    columns are not read. The text decides, no language column is used. Runs per Arrow batch without a shuffle.
    """
    import pyarrow as pa

    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, spans = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = leveled_spans(text)
                rows += [i] * len(found)
                spans += found
            starts, ends, levels = list(zip(*spans)) or [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(levels, pa.int32())], ["doc_id", "sent_start", "sent_end", "level"]
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, sent_start bigint, sent_end bigint, level int")
