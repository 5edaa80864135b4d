"""Tokens, stems and terms of names and annotations, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about a protein.
STOPWORDS = (
    "protein domain containing subunit member regulator fragment precursor chain component factor element unit specific "
    "probable putative possible predicted potential abnormal disabled uncharacterized hypothetical unknown "
    "small large short long terminal internal type like related homolog ortholog paralog family superfamily class"
).split()
# What names, families and domains are taken out by.
NAME_PATTERN = r"(?:Full|Short)=([^;{]+)"
EVIDENCE_PATTERN = r"\{ECO:[^}]*\}"
BELONGS_PATTERN = r"(?i)^(Belongs|Member) to the\s+"
FAMILY_PHRASE = r"(?U)(?i)([\w\s/-]+?)\s+(?:super)?family"
MIXED_CASE = r"(?U)(\b[A-Za-z0-9]+[A-Z0-9][A-Za-z0-9]*\b)"
LONG_WORDS = ((r"(?U)(\b\w+(?:/\w+)+\b)", 4), (r"(?U)(\b\w+(?:-\w+)+\b)", 6), (r"(?U)(\b[A-Za-z]{3,}\b)", 6))
FAMILY_SAID = r"(?U)(?i)Family:\s*([\w-]+(?:\s+\d+)?)"
FAMILY_BELONGS = r"(?U)(?i)Belongs to the\s+([\w-]+(?:\s+[\w-]+)?(?:\s+\d+)?)\s+family"
DOMAIN_WORDS = r"(\b[a-z]{5,}\b)"
RECOMMENDED_NAME = r"RecName: Full=([^;{]+)"
SIMILARITY_STOPWORDS = [*STOPWORDS, *"proteins subfamily group contains domains repeat repeats region regions motif motifs sequence sequences".split()]
# Suffixes in the order in which they are tried.
SUFFIXES = ("ase", "ases", "ing", "ed", "es", "s", "tion", "sion", "ness", "ment")
STEM_LENGTH = 8
NAME_TOKEN_LENGTH = 4
NAME_TOTAL_CHARS = 10


#: Of several suffixes that a word ends with, the one tried first is also the longest that leaves enough, but for
#: `ness`, before which `s` is always taken; so one expression that takes the shortest stem says the same.
_STEM = rf"^(.{{{STEM_LENGTH + 1},}}?)(?:{'|'.join(s for s in SUFFIXES if s != 'ness')})$"


def simple_stem(word: Column) -> Column:
    """A lower-case word without the first suffix that leaves more than STEM_LENGTH letters."""
    return F.regexp_replace(word, _STEM, "$1")


def meaningful_tokens(name: Column, min_length: int = STEM_LENGTH) -> Column:
    """Stems of a name's telling words, in order and with repeats.

    The last `;` part and texts in braces and brackets go; so do numbers, words under three letters, stopwords, and
    stems under min_length.
    """
    name = F.regexp_replace(name, r";\s*[^;]+$", "")
    name = F.regexp_replace(F.regexp_replace(name, r"\{[^}]*\}", ""), r"\([^)]*\)", "")
    # stems are never longer than their words, so shorter runs need not be looked at
    words = F.regexp_extract_all(F.lower(name), F.lit(f"([a-z0-9]{{{max(3, min_length)},}})"), F.lit(1))
    telling = F.filter(words, lambda w: ~w.isin(STOPWORDS) & ~w.rlike("^[0-9]+$"))
    return F.filter(F.transform(telling, simple_stem), lambda w: F.length(w) >= min_length)


def shared(a: Column, b: Column) -> Column:
    """What two arrays have in common, sorted."""
    return F.array_sort(F.array_intersect(a, b))


def longest(terms: Column, min_length: int = 3) -> Column:
    """The longest term, of those as long the first by name; null if under min_length."""
    enough = F.filter(terms, lambda t: F.length(t) >= min_length)
    return F.array_min(F.transform(enough, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))).getField("t")


def all_name_terms(description: Column) -> Column:
    """Tokens of all Full= and Short= names of a description."""
    names = F.regexp_extract_all(description, F.lit(NAME_PATTERN), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(names, lambda n: meaningful_tokens(F.trim(n), NAME_TOKEN_LENGTH))))


def similarity_terms(comments: Column) -> Column:
    """Terms of SIMILARITY comments: the family's name, mixed-case names, and slashed, hyphenated and long words."""
    def of(comment: Column) -> Column:
        text = F.regexp_replace(F.trim(F.substring(comment, 12, 1 << 30)), EVIDENCE_PATTERN, "")
        text = F.regexp_replace(text, BELONGS_PATTERN, "")
        family = F.lower(F.trim(F.regexp_extract(text, FAMILY_PHRASE, 1)))
        families = F.filter(F.array(family), lambda t: F.length(t) >= 3)
        mixed = F.regexp_extract_all(text, F.lit(MIXED_CASE), F.lit(1))
        found = [families, mixed]
        for pattern, least in LONG_WORDS:
            words = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lower)
            found.append(F.filter(words, lambda t, least=least: (F.length(t) >= least) & ~t.isin(SIMILARITY_STOPWORDS)))
        return F.concat(*found)

    return F.array_distinct(F.flatten(F.transform(F.filter(comments, lambda c: c.startswith("SIMILARITY:")), of)))


def family_terms(description: Column, comments: Column) -> Column:
    """Family names said by the description or by comments."""
    said = F.regexp_extract(description, FAMILY_SAID, 1)
    belongs = F.transform(comments, lambda c: F.regexp_extract(c, FAMILY_BELONGS, 1))
    return F.array_distinct(F.filter(F.transform(F.concat(F.array(said), belongs), F.lower), lambda t: t != ""))


# Databases whose third field describes a domain.
TEXT_DATABASES = ("InterPro", "Pfam", "SMART", "PROSITE", "SUPFAM", "PRINTS")


def domain_terms(xrefs: Column, features: Column | None = None) -> Column:
    """Domain names from cross-references (array of struct db, id, props) and words of domain features' notes."""
    described = F.filter(xrefs, lambda x: x["db"].isin(list(TEXT_DATABASES)) & (F.size(x["props"]) >= 1))
    names = F.transform(described, lambda x: F.regexp_replace(F.lower(x["props"][0]), r"[._]\d+$", ""))
    terms = F.filter(names, lambda n: F.length(n) >= 4)
    if features is not None:
        kinds = F.filter(features, lambda f: f["type"].isin("DOMAIN", "REPEAT", "REGION") & f["note"].isNotNull())
        terms = F.concat(terms, F.flatten(F.transform(kinds, lambda f: F.regexp_extract_all(F.lower(f["note"]), F.lit(DOMAIN_WORDS), F.lit(1)))))
    return F.array_distinct(terms)


def xref_ids(xrefs: Column, db: str, strip: bool = False) -> Column:
    """Distinct ids of one database; `strip` cuts them at the first colon."""
    ids = F.transform(F.filter(xrefs, lambda x: x["db"] == db), lambda x: F.substring_index(x["id"], ":", 1) if strip else x["id"])
    return F.array_distinct(ids)


def common_id(a: Column, b: Column) -> Column:
    """The smallest id that two arrays share, else null."""
    return F.array_min(F.array_intersect(a, b))


def sequential_ids(a: Column, b: Column, prefix: str = "PTHR") -> Column:
    """`x/y` for ids of a and b whose numbers after the prefix follow each other, the smaller first; the least such, else null."""
    number = lambda x: F.try_to_number(F.regexp_extract(x, rf"^{prefix}(\d+)", 1), F.lit("9" * 18)).cast("long")
    numbered = lambda ids: F.filter(F.transform(ids, lambda x: F.struct(number(x).alias("n"), x.alias("id"))), lambda s: s["n"].isNotNull())
    lower_first = lambda s, t: F.filter(F.transform(t, lambda y: F.when(y["n"] == s["n"] + 1, F.concat_ws("/", s["id"], y["id"]))), lambda z: z.isNotNull())
    one = F.flatten(F.transform(numbered(a), lambda s: lower_first(s, numbered(b))))
    other = F.flatten(F.transform(numbered(b), lambda s: lower_first(s, numbered(a))))
    return F.array_min(F.concat(one, other))


def first_step(a: Column, b: Column) -> Column:
    """The least n for which one of two arrays of numbers has n and the other n + 1, else null."""
    upper = lambda x, y: F.array_min(F.array_intersect(F.transform(x, lambda n: n + 1), y))
    return F.least(upper(a, b), upper(b, a)) - 1


def recommended_name(description: Column, organism: Column) -> Column:
    """`{RecName Full}; {organism}`, or NAME MISSING."""
    full = F.regexp_extract(description, RECOMMENDED_NAME, 1)
    return F.when(full == "", "NAME MISSING").otherwise(F.concat_ws("; ", F.trim(full), organism))
