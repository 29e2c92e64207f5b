"""Pages that hold template residue, filler, error messages or scripts-required notices instead of content.

Two detectors look at each text, whole:

* *Messages.* What such pages say is a stated list; no template is mined from the corpus. Every line, and every cell of a
  line that crosses columns, is a record, but only records whose first token opens a listed message are looked up, by
  their first ``DEPTH`` tokens, folded (below) and with numbers and ids masked. The verdict of such a beginning, the
  listed messages that can begin so, is worked out once in a worker and kept; where there is one, the rest of the
  record (over the following lines) is checked against the message. A message that other columns cut is followed over
  the ends of its lines and cells to the end of the text, and a few phrases of machines' own words are
  looked for anywhere; what a sentence of a paper can say (a connection failed, a request was refused) counts only at
  a record's beginning. Filler is found as a run of filler words, or a sentence that stands three times in succession. A notice in
  a wording that no list has isn't found.
* *Slots.* Unresolved fields inside ordinary records, by their delimiters or by what stands between soft brackets, and the
  bare values that are printed where a field couldn't be filled.

Misread letters: texts and messages are folded alike, so that letters a scan confuses become the same letter. Verdicts
depend on the text and the lists alone, not on the order or the place of rows, so nothing is shuffled or counted over
tasks and a task that runs again finds the same.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTH = 3
#: Tokens of a record that are compared, and tokens of other columns that may stand between a message's own.
RECORD_TOKENS, FOREIGN_TOKENS = 40, 14
#: Leaves that a worker remembers.
LEAVES = 200_000
#: Filler words in succession that make filler.
FILLER_RUN = 4

# What such pages say. A star stands for one to three tokens, <n> for a number.
MESSAGES = (
    "error <n>", "fehler <n>", "erreur <n>", "http <n>",
    "the server could not complete your request", "too many requests from your address", "timeout while waiting for", "exception in module",
    "warning undefined index", "database connection failed", "ocr engine failure", "your session has expired", "access denied you do not have permission",
    "sorry something went wrong", "this site is down for maintenance", "no text available for this page", "we could not show the zoomable page",
    "you need to enable * to run this reader", "please enable * to view this page", "javascript must be switched on", "scripting must be switched on", "scripts must be switched on", "javascript and cookies must be switched on",
    "this viewer requires *", "your browser does not support the page viewer", "noscript * disabled reader not loaded",
    "veuillez activer * pour consulter cette page", "le lecteur necessite que les scripts", "le service est momentanement indisponible",
    "bitte aktivieren sie * um die seite anzuzeigen", "diese anwendung benotigt aktiviertes", "interner serverfehler bitte versuchen",
    "active * para ver esta pagina", "es necesario habilitar los scripts", "el servidor no pudo completar la solicitud",
    "this is a blind text for", "copy tk copy", "text goes here text goes", "dummy text dummy", "body copy to come", "aqui va el texto", "texte a venir texte",
    "hier steht spater der text", "sample paragraph do not print", "filler filler filler",
)
SUBJECTS = ("reader", "archive", "image server", "server", "scan", "document", "facsimile", "page image", "column image", "issue", "text layer", "requested page", "page", "search service", "viewer", "file")
PREDICATES = (
    "could not be loaded", "could not be delivered", "was not found on this server", "has been removed or renamed", "cannot be displayed", "is not responding",
    "failed to respond in time", "returned an invalid response", "is temporarily unavailable", "you requested does not exist",
)
#: Titles of error pages, as lines of their own.
TITLES = ("Not Found", "Bad Request", "Too Many Requests", "Service Unavailable", "Internal Server Error", "Bad Gateway", "Gateway Timeout", "Unauthorized")
CODED_TITLES = (*TITLES, "Forbidden", "Gone")
#: Words of machines, which no sentence of a paper has: they show a message whose beginning the scan has spoilt.
PHRASES = (
    "not found on this server", "image server", "zoomable page", "page viewer", "serverfehler", "page introuvable", "momentanement indisponible", "servidor no pudo", "completar la solicitud", "pagina no encontrada",
    "undefined index", "exception in module", "retries left", "try reloading", "down for maintenance", "image file missing", "scripts are blocked", "allow scripts", "javascript", "noscript",
    "scripts soient", "habilitar los scripts", "aktivieren sie scripting", "aktivieren sie scripts", "activer scripting", "activer scripts", "active scripting", "active scripts", "enable scripting",
    "enable scripts", "requires scripting", "requires scripts", "scripting must be", "scripts must be", "gateway timeout", "internal server error", "blind text",
)
FILLER = (
    "lorem ipsum dolor amet tempor semper rutra velit mollis vestra ridet lectum vivam etiam quasi felis tellus purus magna porta orna cursor donec nunc nullam gravis sapien sit consectetur adipiscing elit sed",
    "bla blah etc", "asdf asdfjkl jkl qwer uiop test", "filler", "copy tk", "dummy text", "xx xxx xxxx xxxxx xxxxxx xxxxxxx",
)
#: What stands between soft brackets where something is to be put in.
TO_FILL = ("insert", "insertar", "inserer", "einfugen", "add", "your", "here", "to come", "folgt", "fill in", "goes here", "missing", "name of", "a venir", "placeholder", "tbd", "tba")
#: What a paper's own notes between brackets say.
EDITORIAL = ("from our own", "continued", "advt", "see plate", "see last", "editor")

_SAME = (("1", "l"), ("|", "l"), ("rn", "m"), ("vv", "w"), ("cl", "d"), ("(l", "d"), ("li", "h"), ("(", "c"), ("e", "c"), ("u", "n"), ("r", "t"), ("b", "h"), ("i", "l"), ("0", "o"), ("5", "s"), ("8", "h"))
_NUMBER, _MARKS = re.compile(r"\d[\d.,½]*"), re.compile("[\u0300-\u036f]+")
_BROKEN = re.compile(r"[-¬][ \t]*\r?\n[ \t]*")
_WORD = re.compile(r"<n>|[^\W_]+")
#: What a slot begins with.
_SIGN = re.compile(r"[{}\[\]<>$%@#&_*?!]|\(\(\(")
_CELL = re.compile(r"[ \t]{2,}")
_CUT = re.compile(r"[-¬](?:[ \t]{2,}|[ \t]*(?:\n|\Z))")
_LAST = re.compile(r"[^\W_]+\Z")
#: A cell that can begin or go on with a status and its title, which has capitals.
_STATUS = re.compile(r"(?<!\w)[45]\d\d(?!\w)")
_TITLED = re.compile(r"\W*(?:[45]\d\d(?!\w)|[A-Z])")
_PIECE = re.compile(r"[ \t]{2,}|\n")
#: The halves of a word that goes on in a later cell.
_HEAD, _TAIL = re.compile(r"([^\W_]+)[-¬][ \t]*$"), re.compile(r"\W*([^\W_]+)")
_SOFT = (("{", "}"), ("[", "]"), ("<", ">"), ("(((", ")))"))
_STARS = re.compile(r"\*{3,}")


def _masked(m: re.Match) -> str:
    text, start, end = m.string, m.start(), m.end()
    within = (start and text[start - 1].isalpha()) or (end < len(text) and text[end].isalpha())
    return m.group() if within else "<9>"


def fold(text: str) -> str:
    """Lower case, no accents, numbers as ``<n>`` (digits within a word are letters), and one letter for those that scans confuse."""
    text = text.lower()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    text = _NUMBER.sub(_masked, text)
    for a, b in _SAME:
        text = text.replace(a, b)
    return text.replace("<9>", "<n>")


def tokens(folded: str) -> list[str]:
    return _WORD.findall(folded)


def _signature(message: str) -> list[str]:
    return ["*" if w == "*" else "<n>" if w == "<n>" else fold(w) for w in message.split()]


def _said() -> list[str]:
    return [
        *MESSAGES, *(f"<n> {t}" for t in CODED_TITLES), *(f"{a} {subject} {predicate}" for subject in SUBJECTS for predicate in PREDICATES for a in ("the", "this", "our")),
        *(f"item * {predicate}" for predicate in PREDICATES),
    ]


def _agrees(record: list[str], message: list[str], foreign: int) -> bool:
    """Whether the record begins with the message, with at most ``foreign`` tokens of other columns within."""
    at = 0
    for i, want in enumerate(message):
        if want == "*":
            reach = range(at + 1, at + 4)
            after = message[i + 1] if i + 1 < len(message) else None
            if after is None:
                return at < len(record)
            at = next((j for j in reach if j < len(record) and record[j] == after), -1)
            if at < 0:
                return False
            continue
        start = at
        while at < len(record) and record[at] != want:
            at += 1
        foreign -= at - start
        if at == len(record) or foreign < 0 or (i < 2 and at != start):
            return False
        at += 1
    return True


def _between(text: str, opener: str, closer: str) -> Iterator[str]:
    """What stands from each opening bracket to its matching closing one; for one without, to the next that closes."""
    opened, closed = [], []
    for m in re.finditer(f"{re.escape(opener)}|{re.escape(closer)}", text):
        if m.group() == opener:
            opened.append(m.end())
        else:
            closed.append(m.start())
            if opened:
                yield text[opened.pop() : m.start()]
    for start in opened:
        if closed and start <= closed[-1]:
            yield text[start : closed[bisect_left(closed, start)]]


class _Field:
    """The words between two brackets, where lines and cells of other columns may stand within."""

    def __init__(self, text: str, wanted: frozenset[str]):
        cells = _PIECE.split(text)
        self.words: list[str] = []
        heads: list[tuple[int, str]] = []
        #: Wanted words in two halves: the word, where it begins and ends.
        self.halved: list[tuple[str, int, int]] = []
        starts = []
        for cell in cells:
            starts.append(at := len(self.words))
            if tail := _TAIL.match(cell):
                self.halved += [(w, j, at) for j, a in heads if (w := fold(a + tail.group(1))) in wanted]
            self.words += tokens(fold(cell))
            if head := _HEAD.search(cell):
                heads.append((len(self.words) - 1, head.group(1)))
        self.first, self.last = (starts[1] if len(starts) > 1 else len(self.words)), starts[-1]
        ends = cells[0] + cells[-1]
        self.open = not ends.strip()
        #: The first and the last cell are the field's own: where they hold something but no letter, it is a sum or a list.
        self.worded = self.open or any(c.isalpha() for c in ends)

    def find(self, phrase: list[str], begun_only: bool) -> int | None:
        """Where the phrase begins whose words (or words that begin so) stand in this order, whatever stands between them."""
        first, at = None, 0
        for want in phrase:
            whole = next((j for j in range(at, len(self.words)) if (self.words[j].startswith(want) if begun_only else self.words[j] == want)), None)
            ends = [] if whole is None else [(whole + 1, whole)]
            ends += [(k + 1, j) for w, j, k in self.halved if w == want and j >= at]
            if not ends:
                return None
            at, begun = min(ends)
            first = begun if first is None else first
        return first

    def earliest(self, phrases: list[list[str]], begun_only: bool = False) -> tuple[bool, int] | None:
        """Where one of the phrases begins: in the field's own cells before any other."""
        return min(((self.first <= at < self.last, at) for p in phrases if (at := self.find(p, begun_only)) is not None), default=None)


class _Followed:
    """Messages that other columns cut, followed to the end of the text.

    A column is cut at the ends of its lines, or of its cells where a line crosses columns. So a message begins a cell,
    and what a cell leaves of it begins some later cell, however far; within a cell nothing stands between its tokens.
    """

    def __init__(self, messages: list[str]):
        #: The steps of each message; None stands for any token, and the second and third of a star may be left out.
        self.steps: dict[str, list[tuple[str | None, bool]]] = {}
        #: Messages by their longest word, with all their words.
        self.by_word: dict[str, list[tuple[frozenset[str], str]]] = {}
        #: First half of a word: its second halves, and the word.
        self.halves: dict[str, dict[str, set[str]]] = {}
        for message in messages:
            steps: list[tuple[str | None, bool]] = []
            for w in _signature(message):
                steps += [(None, False), (None, True), (None, True)] if w == "*" else [(w, False)]
            self.steps[message] = steps
            words = frozenset(w for w, _ in steps if w)
            self.by_word.setdefault(max(words, key=len), []).append((words, message))
            for w in message.split():
                for k in range(1, len(w)) if w[0].isalpha() else ():
                    self.halves.setdefault(fold(w[:k]), {}).setdefault(fold(w[k:]), set()).add(fold(w))
        self.completed = {h: set().union(*rest.values()) for h, rest in self.halves.items()}

    def held(self, raw: str, words: set[str]) -> list[str]:
        """Messages all of whose words the text holds, whole or perhaps in halves; ``words`` are those of the joined text."""
        heads, tails = [], []
        for m in _CUT.finditer(raw):
            if head := _LAST.search(raw, max(0, m.start() - 30), m.start()):
                heads.append(head.group())
            if tail := _TAIL.match(raw, m.end()):
                tails.append(tail.group(1))
        if heads:
            heads = tokens(fold("\n".join(heads)))
            words = words.union(heads, tokens(fold("\n".join(tails))), *(self.completed[h] for h in heads if h in self.completed))
        return [m for w in self.by_word.keys() & words for own, m in self.by_word[w] if own <= words]

    def _open(self, steps: list[tuple[str | None, bool]], states: set[int]) -> set[int]:
        """With the states that are reached by leaving steps out."""
        out = set()
        for i in states:
            out.add(i)
            while i < len(steps) and steps[i][1]:
                i += 1
                out.add(i)
        return out

    def begins(self, cells: list[tuple[list[str], bool]], message: str) -> bool:
        """Whether the message stands in the cells: the tokens of each, and whether its last word is broken."""
        steps, waiting, broken = self.steps[message], {0}, set()
        for words, cut in cells:
            states = set(waiting)
            for n, w in enumerate(words):
                if cut and n == len(words) - 1 and w in self.halves:
                    broken |= {(i, w) for i in self._open(steps, states) if i < len(steps) and steps[i][0]}
                after = {i + 1 for i in self._open(steps, states) if i < len(steps) and steps[i][0] in (None, w)}
                if n == 0:
                    after |= {i + 1 for i, half in broken if steps[i][0] in self.halves[half].get(w, ())}
                states = after
                if not states:
                    break
                if len(steps) in self._open(steps, states):
                    return True
            waiting |= states
        return False


class Detector:
    def __init__(self) -> None:
        import ahocorasick

        self.followed = _Followed(_said())
        self.openers: dict[str, list[list[str]]] = {}
        for message in map(_signature, _said()):
            self.openers.setdefault(message[0], []).append(message)
        self.leaves: dict[tuple[str, ...], list[list[str]]] = {}
        self.titles = {tuple(_signature(t)): t[0] for t in TITLES}
        self.phrases = ahocorasick.Automaton()
        for p in PHRASES:
            self.phrases.add_word(" ".join(_signature(p)), p)
        self.phrases.make_automaton()
        self.filler = {fold(w): i for i, f in enumerate(FILLER) for w in f.split()}
        name = r"[^\W\d_][\w\-]*(?:[._\-][^\W_]+)*"
        self.hard = re.compile(
            r"\{\s?\{|\}\s?\}|\{%|%\}|\[%|%\]|<%|%>|<\?=|\?>|@@|\[\[|\]\]|\{!|!\}|\[\{|\}\]|#\{|\$\{|\$[^\W\d_]|%\([^\W\d_]|__+[^\W_]|(?<=[^\W_])__+(?!\w)|%%[^\W\d_]"
            rf"|%{name}%|\{{\s?{name}\s?\}}|<<\s?{name}\s?>>|&(?!(?:amp|quot|apos|nbsp|lt|gt|mdash|ndash|eacute);)[^\W\d_][\w.\-]{{3,}};|\(\(\({name}\)\)\)"
            r"|(?<![\d\w])%[sd](?!\w)|%\d\$[sd]|\{\d\}|\[[0o]bjec. [0Oo]bjec.\]|#(?:REF|VALUE|NAME|DIV/0|N/A)"
        )
        self.bare = re.compile(r"(?<!\w)(?:undefined,?\s+undefined|NULL\s+NULL|NaN)(?!\w)")
        self.to_fill = [_signature(p) for p in TO_FILL]
        self.editorial = [_signature(p) for p in EDITORIAL]
        self.asked = frozenset(chain.from_iterable(self.to_fill + self.editorial))

    def leaf(self, head: tuple[str, ...]) -> list[list[str]]:
        """The listed messages that can begin with these tokens."""
        if head not in self.leaves:
            if len(self.leaves) > LEAVES:
                self.leaves.clear()
            self.leaves[head] = [s for s in self.openers.get(head[0], ()) if all("*" in (a, *s[:i]) or a == b for i, (a, b) in enumerate(zip(s, head, strict=False)))]
        return self.leaves[head]

    def message(self, lines: list[str], folded: list[str], words: list[list[str]]) -> bool:
        """Whether a line, or a cell of one, begins a message; ``words`` are the tokens of each line."""
        openers = self.openers.keys() | {t[0] for t in self.titles}
        for i, line in enumerate(folded):
            cells = (words[i], *map(tokens, _CELL.split(line))) if "  " in line else (words[i],)
            for cell in cells:
                if not cell or cell[0] not in openers:
                    continue
                if len(cell) < DEPTH:
                    if tuple(cell) in self.titles and self.titles[tuple(cell)] in lines[i] and not lines[i].rstrip().endswith((",", ";")):
                        return True
                    head = tuple(islice(chain(cell, chain.from_iterable(words[i + 1 : i + 10])), DEPTH))
                else:
                    head = tuple(cell[:DEPTH])
                found = self.leaf(head)
                if found:
                    record = [*cell, *islice(chain.from_iterable(words[i + 1 : i + 10]), max(0, RECORD_TOKENS - len(cell)))]
                    if any(_agrees(record, s, FOREIGN_TOKENS if len(s) > 4 else 0) for s in found):
                        return True
        return False

    def cut(self, raw: str, words: list[str]) -> bool:
        """Whether a message stands in the text that other columns cut; ``words`` are those of the joined text."""
        held = self.followed.held(raw, set(words))
        if not _STATUS.search(raw):
            held = [m for m in held if m[0] != "<"]
        if not held:
            return False
        pieces = _PIECE.split(raw)
        cells = [(own, bool(_HEAD.search(c)), _TITLED.match(c)) for c, f in zip(pieces, fold("\n".join(pieces)).split("\n"), strict=True) if (own := tokens(f))]
        return any(self.followed.begins([(own, cut) for own, cut, titled in cells if titled or m[0] != "<"], m) for m in held)

    def _field(self, text: str) -> str | None:
        """``slot`` if something is to be put in, ``note`` if the paper says something itself: what begins first.

        A note's phrase begins in the field's own cells; elsewhere it is another column's, unless these are empty.
        """
        field = _Field(text, self.asked)
        if not field.worded:
            return None
        fill, note = field.earliest(self.to_fill), field.earliest(self.editorial, True)
        if note is not None and (field.open or not note[0]) and (fill is None or note < fill):
            return "note"
        return None if fill is None else "slot"

    def slot(self, text: str, raw: str) -> bool:
        """``text`` with words joined over line ends, and as it was."""
        soft = False
        for m in _SIGN.finditer(text):
            if self.hard.match(text, m.start()):
                return True
            soft = True
        if ("undefined" in text or "NULL" in text or "NaN" in text) and self.bare.search(text):
            return True
        if not soft:
            return False
        for t in {text, raw}:
            if any(self._field(f) == "slot" for a, b in _SOFT if a in t for f in _between(t, a, b)):
                return True
            stars, noted = list(_STARS.finditer(t)), False
            for a, b in zip(stars, stars[1:], strict=False):
                kind = None if noted else self._field(t[a.end() : b.start()])
                if kind == "slot":
                    return True
                noted = kind == "note"
        return False

    def fills(self, words: list[str]) -> bool:
        """Whether ``FILLER_RUN`` words of one kind of filler follow one another."""
        if self.filler.keys().isdisjoint(words):
            return False
        run, before = 0, None
        for w in words:
            kind = self.filler.get(w)
            run = run + 1 if kind is not None and kind == before else int(kind is not None)
            before = kind
            if run >= FILLER_RUN:
                return True
        return False

    def kind(self, text: str | None) -> str | None:
        """``slot``, ``message``, ``filler`` or null for a text that is content (or empty, or null)."""
        if not text or text.isspace():
            return None
        raw = text.replace("\r", "")
        text = _BROKEN.sub("", text).replace("\r", "")
        if self.slot(text, raw):
            return "slot"
        lines, folded = text.split("\n"), fold(text).split("\n")
        by_line = [tokens(x) for x in folded]
        words = list(chain.from_iterable(by_line))
        if next(self.phrases.iter(" ".join(words)), None) or self.message(lines, folded, by_line) or self.cut(raw, words):
            return "message"
        if self.fills(words):
            return "filler"
        said = [s.strip() for s in " ".join(lines).lower().split(".")]
        if any(a == b == c and len(a) > 6 for a, b, c in zip(said, said[1:], said[2:], strict=False)):
            return "filler"
        return None


_DETECTOR: list[Detector] = []


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not _DETECTOR:
        _DETECTOR.append(Detector())
    for b in batches:
        kinds = [_DETECTOR[0].kind(t) for t in b.column("text").to_pylist()]
        yield pa.record_batch([b.column("doc_id"), pa.array(kinds, pa.string())], names=["doc_id", "kind"])


def judge(documents: DataFrame) -> DataFrame:
    """``doc_id`` and ``kind`` of each row: ``slot``, ``message``, ``filler``, or null for a page with content.

    A null, empty or blank text is no residue. Repeated rows are judged each; a null ``doc_id`` stays; other columns are
    dropped first; texts of any length are judged whole.
    """
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_judge, "doc_id bigint, kind string")


def residue(documents: DataFrame) -> DataFrame:
    return judge(documents).where(F.col("kind").isNotNull())
