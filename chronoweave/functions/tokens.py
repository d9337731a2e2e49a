"""Tokens of texts: a plug point for tokenizers, taggers and entity models, a rule-based default, and views of tokens."""

from __future__ import annotations

import re
from collections.abc import Callable, Collection

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .lemmas import lemma

#: A token: its text, the text with the blanks behind it, its place, and what a model may tell of it ("" entity: none).
TOKEN = "struct<text:string,spaced:string,s:int,e:int,pos:string,tag:string,lemma:string,entity:string>"
_ROW = pa.struct([("text", pa.string()), ("spaced", pa.string()), ("s", pa.int32()), ("e", pa.int32()), ("pos", pa.string()), ("tag", pa.string()), ("lemma", pa.string()), ("entity", pa.string())])
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[^\s]")

#: (s, e, pos, tag, lemma, entity) of a token.
Told = tuple[int, int, str | None, str | None, str, str]


def rule_model(texts: list[str]) -> list[list[Told]]:
    """Words and single marks; numbers and marks have a part of speech, lemmas are lower-cased words, entities none."""

    def told(m: re.Match) -> Told:
        word = m[0]
        pos = "NUM" if word.isdigit() else "X" if word[0].isalnum() else "PUNCT"
        return m.start(), m.end(), pos, None, word.lower(), ""

    return [[told(m) for m in _WORD.finditer(t)] for t in texts]


def lemma_model(known: Collection[str] = ()) -> Callable[[list[str]], list[list[Told]]]:
    """As ``rule_model``, with lemmas by affix rules; where rules leave a choice it falls on a ``known`` lemma."""

    def run(texts: list[str]) -> list[list[Told]]:
        out = []
        for text, tokens in zip(texts, rule_model(texts)):
            words = [text[t[0] : t[1]] for t in tokens]
            out.append([(*t[:4], lemma(w, before, known), t[5]) for t, w, before in zip(tokens, words, ["", *words])])
        return out

    return run


def tokenizer(model: Callable[[list[str]], list[list[Told]]] = rule_model) -> Callable[[Column], Column]:
    """A column function from a model that maps texts to their tokens' places and tags, an Arrow batch at a time. Null texts give null."""

    def run(texts: pa.Array) -> pa.Array:
        given = texts.to_pylist()
        found = iter(model([t for t in given if t is not None]))
        names = [f.name for f in _ROW]

        def whole(text: str, tokens: list[Told]) -> list[dict]:
            ends = [t[0] for t in tokens[1:]] + [tokens[-1][1]] if tokens else []
            return [dict(zip(names, (text[s:e], text[s:until], s, e, *rest))) for (s, e, *rest), until in zip(tokens, ends)]

        return pa.array([None if t is None else whole(t, next(found)) for t in given], pa.list_(_ROW))

    return lambda text: F.arrow_udf(run, f"array<{TOKEN}>")(text)


def part(tokens: Column, first: Column | int, end: Column | int) -> Column:
    """Tokens from ``first``, counted from 0, to ``end``, which is not among them."""
    first, end = (F.lit(x) if isinstance(x, int) else x for x in (first, end))
    return F.slice(tokens, first + 1, F.greatest(end - first, F.lit(0)))


def untokenized(tokens: Column) -> Column:
    return F.trim(F.array_join(F.transform(tokens, lambda x: x["spaced"]), ""))


def token_words(tokens: Column, uncased: bool = False) -> Column:
    return F.transform(tokens, lambda x: F.lower(x["text"]) if uncased else x["text"])


def offsets(tokens: Column) -> Column:
    return F.transform(tokens, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))


def told(tokens: Column, field: str) -> Column:
    """One of ``pos``, ``tag``, ``lemma`` and ``entity`` of each token."""
    return F.transform(tokens, lambda x: x[field])


def entity_groups(tokens: Column) -> Column:
    """``array<struct<text, entity>>``: neighbouring tokens with one entity tag, as their text."""
    name = lambda i: F.coalesce(F.get(tokens, i)["entity"], F.lit(""))
    places = F.when(F.size(tokens) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size(tokens) - 1))
    firsts = F.filter(places, lambda i: (name(i) != "") & (name(i - 1) != name(i)))
    lasts = F.filter(places, lambda i: (name(i) != "") & (name(i + 1) != name(i)))
    return F.transform(F.arrays_zip(firsts.alias("a"), lasts.alias("z")), lambda x: F.struct(untokenized(part(tokens, x["a"], x["z"] + 1)).alias("text"), name(x["a"]).alias("entity")))
