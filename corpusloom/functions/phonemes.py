"""Romanised syllables as phoneme symbols, and symbols as numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, _col, strip

#: fixed values: spellings and their symbols, initials, finals
SYMBOLS = dict(zip(
    "tsh gh gn ng ts ch sh zh kh ph th iaon yaon uaon waon iau yau ioe yoe uoe woe iun yun uen wen ian yan uan wan iaq yaq uaq waq ueq weq ioq yoq iuq yuq yiq aon ia ya ua wa ie ye ue we au oe iu yu in yin en an on ion yon iq aq eq oq yi wu er yeu ieu eu".split(),
    "α β γ η θ λ μ ξ π σ τ ∀ ∃ ∑ ∏ ∆ ∇ √ ∝ ∞ ∠ ∧ ∨ ∩ ∪ ∫ ∴ ∵ ∶ ∷ ≈ ≠ ≡ ≤ ≥ ≮ ≯ ⊕ ⊗ ⊥ æ ç ð ζ þ ß δ ρ ø ε ĳ $ ł & ń # œ ι κ ŕ ś φ ţ @ * ŵ ψ ա բ գ".split(),
))
INITIALS = "tsh gh gn ng ts ch sh zh kh ph th p b m f v t d n l s z c j k g h".split()
FINALS = "iaon yaon uaon waon iau yau ioe yoe uoe woe iun yun uen wen ian yan uan wan iaq yaq uaq waq ueq weq ioq yoq iuq yuq yiq aon yeu ieu ia ya ua wa ie ye ue we au er oe iu yu eu in yin en an on ion yon iq aq eq oq yi wu i u a e o y ng m n".split()
LETTERS = "pbmfvtdnlszcjkhgywaeiou"
TONES = "012345"
MARKS = ",.!?"

_longest = lambda names: "|".join(sorted(names, key=len, reverse=True))
SYLLABLE = f"({_longest(INITIALS)})?({_longest(FINALS)})([0-9]+)"
#: pad, end and blank first, then letters, tones and symbols by code point, then marks
IDS = {c: i for i, c in enumerate(["_", "~", " ", *sorted({*LETTERS, *TONES, *(s.lower() for s in SYMBOLS.values())}), *MARKS])}


def _lookup(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def phonemes(text) -> Column:
    """Every syllable (initial if there is one, final, tone) of every word as
    symbols divided by blanks; letters between syllables go, and a word without
    a syllable stays as it is. Null stays null, no words give an empty text."""
    names = _lookup(SYMBOLS)

    def word(w):
        parts = [F.regexp_extract_all(w, F.lit(SYLLABLE), F.lit(g)) for g in (1, 2, 3)]
        every = F.flatten(F.transform(F.arrays_zip(*[p.alias(f"p{i}") for i, p in enumerate(parts)]), lambda s: F.array(s["p0"], s["p1"], s["p2"])))
        return F.when(w.rlike(SYLLABLE), F.filter(every, lambda p: p.isNotNull() & (p != ""))).otherwise(F.array(w))

    words = F.filter(F.split(strip(_col(text)), SPACE), lambda w: w != "")
    return F.array_join(F.transform(F.flatten(F.transform(words, word)), lambda p: F.coalesce(F.try_element_at(names, p), p)), " ")


def symbol_ids(text) -> Column:
    """Numbers of the known characters of a text, the others left out."""
    return F.filter(F.transform(F.split(_col(text), ""), lambda c: F.try_element_at(_lookup(IDS), c)), lambda i: i.isNotNull())
