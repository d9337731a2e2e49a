"""English lemmas by affix rules, and the forms that share a lemma."""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator

# Words of closed classes, which have no other forms.
INVARIANT = frozenset(
    "a about above across after against all along an and any as at because before behind below between both but by during each either every few for from had he her here his how i if in into "
    "it its later less many more most much my near no nor not now of off on once one only or other our out over own past per prior she since so some such than that the their them then there "
    "these they this those though through thus till to toward under unless until up upon us very we what when where whether which while who whose why will with within without yes yet you your".split()
) - {"had"}
# Forms that no rule leads from to their lemma.
IRREGULAR = {
    "am": "be", "are": "be", "been": "be", "being": "be", "is": "be", "was": "be", "were": "be", "became": "become", "began": "begin", "begun": "begin", "bought": "buy", "brought": "bring",
    "built": "build", "came": "come", "chosen": "choose", "chose": "choose", "did": "do", "does": "do", "done": "do", "drew": "draw", "drawn": "draw", "fell": "fall", "fallen": "fall",
    "felt": "feel", "fought": "fight", "found": "find", "gave": "give", "given": "give", "goes": "go", "gone": "go", "went": "go", "grew": "grow", "grown": "grow", "had": "have", "has": "have",
    "held": "hold", "kept": "keep", "knew": "know", "known": "know", "led": "lead", "left": "leave", "lost": "lose", "made": "make", "met": "meet", "paid": "pay", "ran": "run", "rose": "rise",
    "risen": "rise", "said": "say", "saw": "see", "seen": "see", "sent": "send", "sold": "sell", "spent": "spend", "spoke": "speak", "spoken": "speak", "stood": "stand", "taken": "take", "took": "take",
    "taught": "teach", "told": "tell", "thought": "think", "won": "win", "written": "write", "wrote": "write",
}
#: Before a form in -ing these tell that it is a noun.
DETERMINERS = ("the", "a", "an", "this", "that", "its", "his", "her", "their", "our", "my", "your")
_VOWEL = re.compile("[aeiouy]")
_SILENT = re.compile(r"(?:[cuv]|[aeiou][sz]|at|bl|[dr]g|ang|[cv][ei]d|[^aeiou][uai]r|^[^aeiou]*[aeiou][klmnp])$")


def _shorter(w: str) -> Iterator[str]:
    """What the word may be a form of, the likeliest first."""
    if w.endswith("ies") and len(w) > 4 or w.endswith("ied") and len(w) > 4:
        yield w[:-3] + "y"
    elif w.endswith(("sses", "shes", "ches", "xes", "zzes")):
        yield from (w[:-2], w[:-1])
    elif w.endswith("s") and not w.endswith(("ss", "us", "is")) and len(w) > 3:
        yield w[:-1]
        if w.endswith("es"):
            yield w[:-2]
    elif w.endswith(("ed", "ing")) and not w.endswith("eed"):
        stem = w[: -2 if w.endswith("ed") else -3]
        if len(stem) < 2 or not _VOWEL.search(stem):
            return
        if stem[-1] == stem[-2] and stem[-1] in "bdgmnprt" and len(stem) > 3:
            yield from (stem[:-1], stem)
        else:
            yield from (stem + "e", stem) if _SILENT.search(stem) else (stem, stem + "e")


def lemma(word: str, before: str = "", known: Collection[str] = ()) -> str:
    """The lemma of a word that follows the word ``before``; of several that rules allow one of ``known``, else the likeliest.

    A form in -ing behind a determiner is a noun and its own lemma. Words of closed classes and what has a sign that is no letter stay, in lower case.
    """
    w = word.lower()
    if w in IRREGULAR:
        return IRREGULAR[w]
    if w in INVARIANT or not w.isalpha() or (w.endswith("ing") and before.lower() in DETERMINERS):
        return w
    options = list(_shorter(w))
    return next((x for x in options if x in known), options[0] if options else w)


def forms(of: str, known: Collection[str] = ()) -> list[str]:
    """All words, none of them behind a determiner, whose lemma is ``of``; none if it is itself a form of another lemma."""
    if lemma(of, known=known) != of:
        return []
    if of in INVARIANT:
        return [of]
    made = {of, *(of + x for x in ("s", "es", "d", "ed", "ing")), *(of + of[-1:] + x for x in ("ed", "ing")), of[:-1] + "ing", of[:-1] + "ies", of[:-1] + "ied", *(w for w, base in IRREGULAR.items() if base == of)}
    return sorted(w for w in made if lemma(w, known=known) == of)
