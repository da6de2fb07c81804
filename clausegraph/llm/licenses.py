"""License scans: template markup compiled to token automata.

A template is license wording with marked regions. `<<optional>> ... <<end>>` may be missing; `<<any a b>>` stands for
a to b words of any kind (names, years, replaceable wording). All other wording is mandatory and must match word for
word. Each template becomes a token automaton; a text is accepted where the automaton reaches its final state.

Cases: a null or empty text has no words, no labels and score 0. Repeated and overlapping places all count. Very long
texts are scanned in one pass; an automaton is only run over texts holding its longest mandatory wording, which every
accepted text must hold. Other columns of the input are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .common import per_document, words

#: Phrases of the base labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Wording of well-known license texts and notices, with markup.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 <<optional>>(the \"License\"); you may not use this file except in compliance with the License<<end>>",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<optional>>1.<<end>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<optional>>2.<<end>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "cc-notice": "Licensed under <<optional>>the<<end>> <<optional>>Creative Commons<<end>> <<optional>>license<<end>> CC BY <<any 0 2>> 4.0",
    "gpl-3.0-notice": "licensed under the <<optional>>terms of the<<end>> <<optional>>GNU<<end>> General Public License, <<optional>>as published by the Free Software Foundation, either<<end>> version 3",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-notice": "<<optional>>Released<<end>> <<optional>>Distributed<<end>> under the MIT License",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"<<any 1 3>>\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<optional>>(including the next paragraph)<<end>> shall be included in all copies or substantial portions of the Software.",
}


class Automaton:
    """States 0..final; `step[s]` maps a word to the next states, `loose[s]` takes any word, `skip[s]` takes none."""

    def __init__(self, template: str):
        self.step: list[dict[bytes, set[int]]] = [{}]
        self.loose: list[set[int]] = [set()]
        self.skip: list[set[int]] = [set()]
        at, opened, runs, run = 0, [], [], []
        for part in re.split(r"(<<.*?>>)", template):
            if part == "<<optional>>":
                opened.append(at)
                runs, run = [*runs, run], []
            elif part == "<<end>>":
                self.skip[opened.pop()].add(at)
                runs, run = runs, []
            elif part.startswith("<<any "):
                low, high = map(int, part[6:-2].split())
                runs, run = [*runs, run], []
                ends = []
                for k in range(high):
                    if k >= low:
                        ends.append(at)
                    self.loose[at].add(at := self._new(at))
                for e in ends:
                    self.skip[e].add(at)
            else:
                for w in words(part.encode()):
                    new = self._new(at)
                    self.step[at].setdefault(w, set()).add(new)
                    at = new
                    if not opened:
                        run = [*run, w]
        if opened:
            raise ValueError("an optional region isn't ended")
        self.final = at
        #: The longest mandatory wording without a gap; it must stand in every accepted text.
        self.needs = b" " + b" ".join(max([*runs, run], key=len)) + b" "
        self.start = self._closed({0})

    def _new(self, _: int) -> int:
        self.step.append({})
        self.loose.append(set())
        self.skip.append(set())
        return len(self.step) - 1

    def _closed(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.skip[todo.pop()] - seen:
                seen.add(s)
                todo.append(s)
        return frozenset(seen)

    def accepts(self, text: list[bytes]) -> bool:
        """Whether some run of consecutive words is accepted; one pass, all starts at once."""
        now = self.start
        for w in text:
            if self.final in now:
                return True
            after = set()
            for s in now:
                after.update(self.loose[s], self.step[s].get(w, ()))
            now = self._closed(after) | self.start if after else self.start
        return self.final in now


def compiled(templates: dict[str, str]) -> dict[str, Automaton]:
    return {label: Automaton(t) for label, t in templates.items()}


def scan(text: bytes | None, phrases: list[tuple[bytes, str]], automata: dict[str, Automaton]) -> dict:
    tokens = words(text)
    joined = b" " + b" ".join(tokens) + b" "
    found: list[tuple[int, str]] = []
    for phrase, label in phrases:
        at, seen, counted = joined.find(phrase), 0, 0
        while at >= 0:
            seen, counted = seen + joined.count(b" ", counted, at), at
            found.append((seen, label))
            at = joined.find(phrase, at + 1)
    base = {label for _, label in found}
    own = {label for label, a in automata.items() if a.needs in joined and a.accepts(tokens)}
    return {
        "n_words": len(tokens), "n_base": len(found),
        "first_word": min(found)[0] if found else None, "last_word": max(found)[0] if found else None,
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | own)),
        "score": 1.0 if own else 0.5 if base else 0.0,
    }


def license_scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (1 where a template is accepted, 0.5 for a phrase alone)."""
    spaced = [(b" " + b" ".join(words(p.encode())) + b" ", label) for p, label in (PHRASES if phrases is None else phrases).items()]
    automata = compiled(TEMPLATES if templates is None else templates)

    def work(_, texts):
        rows = [scan(t, spaced, automata) for t in texts]
        return {n: [r[n] for r in rows] for n in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}

    return per_document(docs, "doc_id long,n_words long,n_base long,first_word long,last_word long,base_labels string,labels string,score double", work)
