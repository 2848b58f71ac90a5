"""License scan by template markup (operator 2).

A template is mandatory wording with optional regions ``[[...]]``, which may hold others, and replaceable ones
``{{n}}`` of up to n words. It compiles to a token automaton. A run of mandatory words tells where a
template may stand: the automaton runs over hashed words from each place that is as far before such a
run as the template allows. Bare license phrases are found besides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import TEMPLATES
from .words import ALPHANUMERIC, hash_word, hashed_words, text_slices

#: Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
_ANY = 0
#: Words of a run that is looked for at most.
RUN = 4
_MARKUP = re.compile(r"\[\[|\]\]|\{\{\d+\}\}|[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def markup(template: str) -> list[str]:
    """A template's parts: ``[[``, ``]]``, ``{{n}}`` and words, in lower case from A to Z as those of texts."""
    return _MARKUP.findall(re.sub("[A-Z]", lambda m: m[0].lower(), template))


class Automaton:
    """States are numbered along the template; ``steps[s]`` has the word's hash (or ``_ANY``) that leads on, ``skips[s]`` states entered for nothing.

    ``run``: consecutive mandatory words; ``least`` and ``most``: how many words a match has before them.
    """

    def __init__(self, template: str):
        self.steps: list[int] = []
        self.skips: dict[int, list[int]] = {}
        opened: list[int] = []
        runs: list[tuple[list[int], int, int]] = []  # hashes, words before: at least, at most
        least, fresh = 0, True
        for part in markup(template):
            here = len(self.steps)
            if part == "[[":
                opened.append(here)
                fresh = True
            elif part == "]]":
                self.skips.setdefault(opened.pop(), []).append(here)
                fresh = True
            elif part.startswith("{{"):
                end = here + int(part[2:-2])
                for s in range(here, end):
                    self.skips.setdefault(s, []).append(end)
                self.steps += [_ANY] * (end - here)
                fresh = True
            else:
                self.steps.append(hash_word(part.encode()))
                if opened:
                    continue
                if fresh or len(runs[-1][0]) == RUN:
                    runs.append(([], least, here))
                    fresh = False
                runs[-1][0].append(self.steps[-1])
                least += 1
        if opened or not runs:
            raise ValueError("a template needs mandatory words and closed regions: " + template[:60])
        self.run, self.least, self.most = max(runs, key=lambda r: (len(r[0]), r[1] - r[2], -r[2]))

    def starts(self, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
        """``(text, place)`` from which the automaton has to be run, each once."""
        past = -1
        for at in _places(words, self.run):
            text = int(np.searchsorted(bounds, at, side="right")) - 1
            if at + len(self.run) <= bounds[text + 1]:
                for place in range(max(past + 1, int(bounds[text]), at - self.most), at - self.least + 1):
                    yield text, place
                    past = place

    def _entered(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for s in self.skips.get(todo.pop(), ()):
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return out

    def matches(self, words: list[int]) -> bool:
        """Whether some prefix of ``words`` is the template."""
        states = self._entered({0})
        for w in words:
            if len(self.steps) in states:
                return True
            states = self._entered({s + 1 for s in states if s < len(self.steps) and self.steps[s] in (w, _ANY)})
            if not states:
                return False
        return len(self.steps) in states


def pattern(template: str) -> str:
    """The template as a regular expression over words that each stand between two spaces."""
    out = []
    for part in markup(template):
        out.append({"[[": "(?:", "]]": ")?"}.get(part) or (f"(?: [^ ]+ ){{0,{part[2:-2]}}}" if part.startswith("{{") else f" {part} "))
    return "".join(out)


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id") -> DataFrame:
    """One row ``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` for each row of ``docs``.

    ``n_base`` counts the places of bare phrases, ``first_word`` and ``last_word`` are the smallest and the
    largest of them (null if none). ``labels`` adds those of templates whose mandatory wording stands in the
    text exactly; a template without mandatory words is refused; a label ends before its first ``#``. ``score`` is 1 with a full template, 0.6 with phrases only, else 0. Null and empty texts
    have no words. Repeated rows are scanned each. Columns other than ``id_col`` and ``text`` are not read.
    """
    templates = TEMPLATES if templates is None else templates

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [(label.partition("#")[0], Automaton(t)) for label, t in templates.items()]
        phrases = [(label, [hash_word(w.encode()) for w in p.split()]) for p, label in PHRASES.items()]
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for low, high, data, offsets in text_slices(batch):
                words, bounds, _, _ = hashed_words(data, offsets, ALPHANUMERIC)
                base: dict[int, list[tuple[int, str]]] = {}
                full: dict[int, set[str]] = {}
                for label, p in phrases:
                    for at in _places(words, p):
                        text = int(np.searchsorted(bounds, at, side="right")) - 1
                        if at + len(p) <= bounds[text + 1]:
                            base.setdefault(text, []).append((at - int(bounds[text]), label))
                for label, a in automata:
                    for text, at in a.starts(words, bounds):
                        if label not in full.get(text, ()) and a.matches(words[at : min(int(bounds[text + 1]), at + len(a.steps))].tolist()):
                            full.setdefault(text, set()).add(label)
                for i in range(high - low):
                    places = base.get(i, [])
                    own = {label for _, label in places}
                    values = (
                        int(bounds[i + 1] - bounds[i]),
                        len(places),
                        min((at for at, _ in places), default=None),
                        max((at for at, _ in places), default=None),
                        ",".join(sorted(own)),
                        ",".join(sorted(own | full.get(i, set()))),
                        1.0 if i in full else 0.6 if places else 0.0,
                    )
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
            kinds = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], _NAMES)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), "text").mapInArrow(scan, _SCHEMA)


_NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _places(words: np.ndarray, run: list[int]) -> list[int]:
    """Where the hashes of ``run`` stand consecutively."""
    at = np.flatnonzero(words == np.uint64(run[0]))
    for i, w in enumerate(run[1:], 1):
        at = at[at + i < len(words)]
        at = at[words[at + i] == np.uint64(w)]
    return at.tolist()
