"""Word lists over texts: risk terms with negation, dominant aspect, a small sentiment scorer."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: Risk terms, each with the words and phrases that mean it.
RISK = {
    "overheat": ["overheat", "overheating", "overheated"],
    "burning smell": ["burning smell", "burn smell"],
    "caught fire": ["caught fire", "catch fire", "catches fire", "burst into flames"],
    "fire hazard": ["fire hazard"],
    "exploded": ["exploded", "explode"],
    "electric shock": ["electric shock"],
    "sparking": ["sparking"],
    "rash": ["rash", "rashes"],
    "allergic": ["allergic", "allergy"],
    "toxic": ["toxic", "poisonous"],
    "injury": ["injury", "injuries", "chemical burn"],
    "choking hazard": ["choking hazard"],
    "fake": ["fake", "counterfeit", "knockoff"],
    "recall": ["recall", "recalled"],
    "lawsuit": ["lawsuit", "class action"],
}
#: Phrases in which a term is no risk; negating words; words that end a clause.
EXCLUDED = "fire tv stick,fire tv,fire stick,fire hd,kindle fire,amazon fire,fire sale,fire department,fire drill,fire pit,fireplace,fire place,fire truck,fire engine,fire extinguisher,hot deal,hot sale".split(",")
NEGATORS = "no not never none without zero neither nor hardly scarcely n't cannot cant wont dont didnt wasnt isnt arent".split()
BREAKERS = (".", "!", "?", ";", "but", "however", "although")
NEGATION_TOKENS = 3
#: Words of each aspect, most severe aspect first, and phrases in which they don't count.
ASPECTS = {
    "safety": "overheat,overheats,overheating,overheated,fire,burning,burn,burns,rash,rashes,allergic,allergy,allergies,toxic,injury,injuries,hazard,hazards,safe,safety,dangerous,danger,poisonous,choking,electric shock,shock,exploded,explode,smoke,smoking,recall,recalled,collapse",
    "refund": "refund,refunds,refunded,refunding,return,returns,returned,returning,return label,return window,return policy,money back,reimbursement,reimburse,exchange,exchanged,replacement,replace,replaced,customer service,customer care,customer support",
    "delivery": "delivery,deliver,delivered,delivering,shipping,ship,shipped,arrived,arrive,arrives,arriving,courier,carrier,driver,package,packages,packaging,parcel,transit,transit damage,box",
    "quality": "quality,material,materials,fabric,build,sturdy,durable,durability,defect,defective,broke,broken,flimsy,snapped,snaps,snap,snapping,cheap,craftsmanship,zipper,zippers,button,buttons,seam,seams,battery,motor,blade,screen,screens,sound,earbuds,headphones,bluetooth,connection,performance,works,working,work,stopped turning on,turning on,turn on,toaster,stroller,blender,grinder,sheet,cable,charger,coating,finish,handle,features,manual",
}
ASPECT_EXCLUDED = "fire tv stick,fire tv,fire stick,fire hd,kindle fire,amazon fire,fire sale,fire department,fire drill,fire pit,fireplace,fire place,fire truck".split(",")
#: Words of the scorer.
POSITIVE = "good great lovely sturdy easier perfect love better firmly neatly politely spotless silently clean well clear fast warm cool new".split()
NEGATIVE = "bad rude cracked leaked broke broken jammed rattles peeled scratched yellow unsafe refund sadly pinched smoke hot bent loose tore costs".split()

_WORDS = {p: c for c, ps in RISK.items() for p in ps}
_RISK = re.compile(rf"\b(?:{'|'.join(sorted(map(re.escape, _WORDS), key=len, reverse=True))})\b")
_EACH = [(re.compile(rf"\b{re.escape(w)}\b"), c) for w, c in _WORDS.items()]
_EXCLUDED = re.compile(rf"\b(?:{'|'.join(sorted(map(re.escape, EXCLUDED), key=len, reverse=True))})\b")
_ASPECT_EXCLUDED = re.compile(rf"\b(?:{'|'.join(sorted(map(re.escape, ASPECT_EXCLUDED), key=len, reverse=True))})\b")
_TOKENS = re.compile(r"\b[\w']+\b|[.,!?;]")
_SENTENCES = re.compile(r"(?<=[.!?\n])\s+")
# whole words are looked up, phrases searched; words inside a phrase count on their own too
_ASPECT_WORDS = {w: a for a, ws in ASPECTS.items() for w in ws.split(",") if " " not in w}
_ASPECT_PHRASES = [(w, re.compile(rf"\b{re.escape(w)}\b"), a) for a, ws in ASPECTS.items() for w in ws.split(",") if " " in w]
_SEVERITY = {a: k for k, a in enumerate(reversed(ASPECTS), 1)}
_WORD = re.compile(r"\w+")


def risk_terms(text: str | None) -> list[str]:
    """The risk terms of a text in order of their first place, without negated and excluded ones."""
    if not text:
        return []
    low = text.lower()
    if not _RISK.search(low):
        return []
    # each term on its own, so that overlapping ones are all found
    hits = sorted(((m.start(), m.end(), term) for p, term in _EACH for m in p.finditer(low)))
    out_of_scope = [m.span() for m in _EXCLUDED.finditer(low)]
    tokens = [(m.start(), m.group()) for m in _TOKENS.finditer(low)]
    found: list[str] = []
    for start, end, term in hits:
        if any(a <= start and end <= b for a, b in out_of_scope):
            continue
        before = [t for at, t in tokens if at < start][-NEGATION_TOKENS:]
        negated = False
        for t in reversed(before):
            if t in BREAKERS:
                break
            if t in NEGATORS or t.endswith("n't"):
                negated = True
                break
        if not negated and term not in found:
            found.append(term)
    return found


def dominant_aspect(text: str | None) -> tuple[str | None, str | None]:
    """The aspect with most sentences, then most matches, then severity, and its sentences."""
    if not text or not text.strip():
        return None, None
    matches: dict[str, int] = {}
    kept: dict[str, list[str]] = {}
    for s in (p.strip() for p in _SENTENCES.split(text)):
        low = s.lower()
        hits = [(m.span(), _ASPECT_WORDS[m.group()]) for m in _WORD.finditer(low) if m.group() in _ASPECT_WORDS]
        hits += [(m.span(), a) for w, p, a in _ASPECT_PHRASES if w in low for m in p.finditer(low)]
        if hits:
            spans = [m.span() for m in _ASPECT_EXCLUDED.finditer(low)]
            found = [a for (lo, hi), a in hits if not any(x <= lo and hi <= y for x, y in spans)]
            for a in found:
                matches[a] = matches.get(a, 0) + 1
            for a in set(found):
                kept.setdefault(a, []).append(s)
    if not matches:
        return None, None
    best = max(matches, key=lambda a: (len(kept[a]), matches[a], _SEVERITY[a]))
    return best, " ".join(kept[best])


@F.pandas_udf(ArrayType(StringType()))
def risk_terms_of(text: pd.Series) -> pd.Series:
    return text.map(risk_terms)


@F.pandas_udf(StructType([StructField("aspect", StringType()), StructField("aspect_text", StringType())]))
def aspect_of(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([dominant_aspect(t) for t in text], columns=["aspect", "aspect_text"])


def _matches(text: Column, words: list[str]) -> Column:
    return F.regexp_count(F.lower(text), F.lit(rf"(?<![A-Za-z0-9_])(?:{'|'.join(words)})(?![A-Za-z0-9_])"))


def sentiment(text: Column) -> dict[str, Column]:
    """``p_pos``, ``p_neg`` and ``score`` = p_pos - p_neg by the scorer's words; null for blank texts. Another scorer may give the same columns."""
    pos, neg = _matches(text, POSITIVE), _matches(text, NEGATIVE)
    some = F.length(F.trim(text)) > 0
    share = lambda n: F.when(some, n / (pos + neg + F.lit(0.25)))
    return {"p_pos": share(pos), "p_neg": share(neg), "score": share(pos - neg)}


def mismatch(rating: Column, p_pos: Column, p_neg: Column) -> Column:
    """High rating with a negative text or low rating with a positive one; false at 3; null without a score."""
    hit = ((rating >= 4) & (p_neg >= 0.8)) | ((rating <= 2) & (p_pos >= 0.8))
    return F.when(p_pos.isNotNull(), hit)


