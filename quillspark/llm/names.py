"""Variant spellings of names typed by people: the spellings that mean one person or organisation."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.metric_join import radius_pairs
from quillspark.operators.joins import skew_join
from quillspark.runtime import materialize, ship_package

#: Academic titles, parts that belong to a family name, and small words of organisation names.
TITLES = {"dr", "prof", "professor", "mr", "mrs", "ms", "sir", "phd", "ing"}
PARTICLES = {"von", "van", "der", "den", "de", "la", "del", "della", "da", "di", "du", "dos", "al", "el", "bin", "ibn", "ter", "ten", "le", "zu", "zum", "zur", "af", "av", "st"}
SMALL = {"the", "for", "of", "on", "and", "in", "fur", "de", "la"}
#: Kinds of organisations, with their short forms.
KINDS = {
    "consortium": "consortium", "consort": "consortium", "wg": "group", "collaboration": "collaboration", "collab": "collaboration", "laboratory": "laboratory", "lab": "laboratory", "labs": "laboratory",
    "group": "group", "team": "team", "institute": "institute", "inst": "institute", "network": "network", "centre": "centre", "center": "centre", "university": "university",
    "univ": "university", "department": "department", "dept": "department", "project": "project", "society": "society", "initiative": "initiative", "association": "association", "committee": "committee",
}
#: Short and pet forms of given names that are no prefix of the full form, or could be one of another name.
NICKNAMES = {
    "adela": ["ada", "adele"], "albin": ["al", "alby"], "alexander": ["alex", "sasha", "sandy"], "anna": ["annie", "anni"], "anselm": ["ansi"], "antonia": ["toni", "tony"], "bastian": ["basti"], "beate": ["bea"], "benedikt": ["ben", "benni", "bene"],
    "birgit": ["biggi", "gitte"], "carina": ["cari"], "casimir": ["cas", "kasi"], "cordula": ["cora", "cordi"], "damian": ["dami"], "darius": ["dari"], "dorothea": ["dora", "thea", "dorle", "doro"], "edgar": ["ed", "eddie"],
    "elisabeth": ["betty", "lisa", "elsa", "lisbeth", "liesl", "sissi", "beth"], "emilian": ["emil", "milian"], "fabian": ["fabi", "fabs"], "florentine": ["flora", "flo", "tina"], "friedrich": ["fritz", "fred", "freddy"], "gabriele": ["gabi", "gaby", "ela"],
    "gideon": ["gid"], "gustav": ["gus", "gustl"], "hannah": ["hanna", "hanni"], "henrik": ["henk", "harry", "rik"], "hilda": ["hilde"], "ignatius": ["iggy", "naz"], "ingrid": ["inga", "inge"], "ivana": ["iva", "vana"], "jaromir": ["jarek", "jaro"],
    "johanna": ["jo", "hansi", "jojo"], "julius": ["jules", "juli"], "katharina": ["kate", "kathi", "katja", "kathy", "katie", "trina"], "kira": ["kiki"], "konrad": ["conny", "kurt", "konni", "radek"], "leonhard": ["leo", "len", "hardy"], "lorenz": ["enzo", "lenz"],
    "ludovica": ["lula", "vica", "ludi"], "magdalena": ["magda", "lena", "leni", "maggie"], "matthias": ["hias", "matt", "mats", "matz"], "mirella": ["mira", "mirel"], "natalia": ["nat", "tasha", "talia", "natasha"], "nikolai": ["nick", "klaus", "niko", "kolja"], "noemi": ["mimi"],
    "odette": ["detta"], "olympia": ["pia", "oly"], "oskar": ["ossi"], "patrizia": ["pat", "patty", "tricia"], "paulus": ["paul", "pauli"], "philippa": ["pippa", "pip"], "quentin": ["quinn"], "quirina": ["rina", "quiri"], "raphael": ["rafi", "rafa", "raf"],
    "robert": ["bob", "rob", "bert"], "roderick": ["rod", "rory", "rick"], "rosalind": ["rosa", "rosie", "linda", "roz"], "sebastian": ["seb", "wastl"], "seraphina": ["sera", "fina"], "silvester": ["sil", "vester", "silvio"], "tabitha": ["tabby"], "theodor": ["ted", "theo", "teddy"],
    "tomasin": ["tom", "tomas", "sina"], "ulrich": ["uli", "ulli"], "ursula": ["uschi", "ulla", "ursel"], "valentin": ["val", "valli"], "veronika": ["vroni", "nika", "vera", "ronnie"], "viktor": ["vic", "vick", "vito"], "walburga": ["burga", "wally"], "wendel": ["wendy"],
    "wilhelmina": ["billie", "mina", "minna", "willa"], "william": ["bill", "will", "willy"], "xaver": ["xavi", "veri"], "xenia": ["xeni", "senia"], "yannick": ["yann"], "yolanda": ["yola", "jolanda"], "zacharias": ["zach", "zack"], "zenobia": ["zena", "nobia"],
}
_TOKEN = re.compile(r"([^\W\d_]+)(\.?)|(,)")
_LETTERS = str.maketrans({"ø": "o", "ß": "ss", "æ": "a", "œ": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"})


def plain(word: str) -> str:
    """Lower case without marks. A marked letter written as two (ae, oe, ue) stays one edit away from the bare letter."""
    word = unicodedata.normalize("NFKD", word.lower()).translate(_LETTERS)
    return "".join(c for c in word if not unicodedata.combining(c))


_FORMAL = {plain(n): plain(full) for full, names in NICKNAMES.items() for n in names}
_KIND = {plain(k): v for k, v in KINDS.items()}


def _one_edit(a: str, b: str) -> bool:
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k:] == b[k + 1 :] if len(a) < len(b) else a[k + 1 :] == b[k + 1 :] or (a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :])


def _kind_of(word: str) -> str | None:
    if word in _KIND:
        return _KIND[word]
    if len(word) >= 8:
        for k, v in _KIND.items():
            if len(k) >= 8 and k[0] == word[0] and abs(len(k) - len(word)) <= 1 and _one_edit(word, k):
                return v
    return None


def parse(name: str) -> tuple[str, str, str, str, str, bool]:
    """(kind, family, given, short, middle, unsure) of one spelling.

    kind is "" for persons. ``given`` is a full given name, formal if the spelling uses a pet form; ``short`` is an initial
    or cut-off given name; ``middle`` holds further initials. ``unsure`` marks two plain words whose order is not known:
    family is then the second. For organisations family is the place or name and given the field of work.
    """
    text = unicodedata.normalize("NFKC", name)
    text = re.sub(r"[\d*†‡§¶]+", " ", text).strip(" ,;")
    tokens = []
    for m in _TOKEN.finditer(text):
        if m.group(3):
            tokens.append((",", ",", False))
        else:
            word = plain(m.group(1))
            if word not in TITLES:
                tokens.append((word, m.group(1), bool(m.group(2))))
    while tokens and tokens[0][0] == ",":
        tokens.pop(0)
    words = [t for t in tokens if t[0] != ","]
    if not words:
        return "", "", "", "", "", False
    kinds = [(i, k) for i, t in enumerate(words) if (k := _kind_of(t[0])) and (t[0] != "wg" or 1 < i == len(words) - 1)]
    if kinds and len(words) >= 2:
        at, kind = kinds[-1] if kinds[0][0] else kinds[0]
        rest = [t[0] for i, t in enumerate(words) if i not in {j for j, _ in kinds} and t[0] not in SMALL and t[0] != "working"]
        if len(rest) >= 2:
            first = kinds[0][0] == 0 or words[0][0] == "working"
            field, place = (rest[0], "".join(rest[1:])) if first else (rest[-1], "".join(rest[:-1]))
            return kind, place, field, "", "", False
        return kind, "".join(rest), "", "", "", False
    comma = next((i for i, t in enumerate(tokens) if t[0] == ","), -1)
    unsure = False
    if 0 < comma < len(tokens) - 1:
        family, given = [t for t in tokens[:comma] if t[0] != ","], [t for t in tokens[comma + 1 :] if t[0] != ","]
    else:
        part = [i for i, t in enumerate(words[:-1]) if t[0] in PARTICLES and not t[2] and not (len(t[1]) == 2 and t[1].isupper() and not words[i + 1][1].isupper())]
        small = [i for i, t in enumerate(words) if _is_short(t)]
        if part and part[-1] + 1 < len(words):
            lo, hi = part[0], part[-1] + 2
            family, given = words[lo:hi], words[:lo] + words[hi:]
        elif len(words) == 1:
            family, given = words, []
        elif small and small[0] == 0:
            cut = next((i for i in range(len(words)) if not _is_short(words[i])), len(words) - 1)
            family, given = words[cut:], words[:cut]
        elif small and small[-1] == len(words) - 1:  # family first, then given names and initials
            family, given = words[:1], words[1:]
        elif small:  # an initial between the names
            family, given = words[small[-1] + 1 :], words[: small[-1] + 1]
        else:
            family, given, unsure = words[-1:], words[:-1], True
    fam = "".join(t[0] for t in family)
    if not given:
        return "", fam, "", "", "", False
    head, middle = given[0], "".join(t[0][0] for t in given[1:])
    if _is_short(head):
        if len(head[0]) == 2 and not head[2]:
            return "", fam, "", head[0][0], head[0][1] + middle, False
        return "", fam, "", head[0], middle, False
    full = head[0]
    return "", fam, full if unsure else _FORMAL.get(full, full), "", middle, unsure


def _is_short(t: tuple[str, str, bool]) -> bool:
    """Initials, two initials in one, and cut-off words with a point."""
    word, shown, point = t
    if len(word) == 1 or (point and word not in TITLES):
        return True
    return len(word) == 2 and word not in PARTICLES and (shown.isupper() or word not in _FORMAL)


def _parsed(column: str):
    @F.pandas_udf("kind string, family string, given string, short string, middle string, unsure boolean")
    def parsed(names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(n) for n in names], columns=["kind", "family", "given", "short", "middle", "unsure"])

    return parsed(F.col(column))


def _formal(word):
    """The formal name of a pet form, any other word as it is."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in _FORMAL.items() for x in kv])[word], word)


def spellings(df: DataFrame, column: str) -> DataFrame:
    """(name, times) of the elements of an array column without outer blanks; null and blank elements are no name."""
    blank = r"^[\s ]+|[\s ]+$"
    names = df.select(F.explode(column).alias("name")).select(F.regexp_replace("name", blank, "").alias("name")).where("name <> ''")
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("times"))


def _oriented(rows: DataFrame) -> DataFrame:
    """Settle the order of two plain words by how often each word stands as a given and as a family name elsewhere."""
    sure = rows.where("kind = '' and not unsure")
    both = rows.where("unsure")
    votes = (
        sure.where("given <> ''").select(F.col("given").alias("w"), F.lit(4.0).alias("g"), F.lit(0.0).alias("f"))
        .unionByName(sure.select(F.col("family").alias("w"), F.lit(0.0).alias("g"), F.lit(4.0).alias("f")))
        .unionByName(both.select(F.col("given").alias("w"), F.lit(1.0).alias("g"), F.lit(0.0).alias("f")))
        .unionByName(both.select(F.col("family").alias("w"), F.lit(0.0).alias("g"), F.lit(1.0).alias("f")))
    )
    odds = votes.groupBy("w").agg(((F.sum("g") + 0.5) / (F.sum("g") + F.sum("f") + 1)).alias("p"))
    met = both.join(odds.toDF("given", "p1"), "given").join(odds.toDF("family", "p2"), "family")
    pet = [F.col(c).isin(*_FORMAL) for c in ("given", "family")]
    p1, p2 = F.when(pet[0], 0.99).otherwise(F.col("p1")), F.when(pet[1], 0.99).otherwise(F.col("p2"))
    keep = p1 * (1 - p2) >= p2 * (1 - p1)
    turned = met.select(
        "name", "times", "kind", F.when(keep, F.col("family")).otherwise(F.col("given")).alias("family"),
        _formal(F.when(keep, F.col("given")).otherwise(F.col("family"))).alias("given"), "short", "middle",
    )
    return rows.where("not unsure").select(turned.columns).unionByName(turned)


def _yields(rows: DataFrame) -> DataFrame:
    """(a, b, wb): the better supported words b within one edit that a word a may stand for, with their support (n, t, word),
    for family names (f) and given names (g) apart."""
    words = rows.select(F.concat(F.lit("ff"), "family").alias("word"), "name", "times").unionByName(rows.where("given <> ''").select(F.concat(F.lit("gg"), "given").alias("word"), "name", "times"))
    weight = materialize(words.where("length(word) >= 5").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("times").alias("t")), "name-words")
    near = radius_pairs(weight, "word", 1)
    ways = near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    w = F.struct("n", "t", "word")
    met = ways.join(weight.select(F.col("word").alias("a"), w.alias("wa")), "a").join(weight.select(F.col("word").alias("b"), w.alias("wb")), "b")
    # a word that is not rare itself yields only to one with much more support, since two names in use are two names; but a
    # marked letter written as two (ae, oe, ue, aa) is no other family name
    bare = lambda c: F.regexp_replace(c, "([aou])e|(a)a", "$1$2")
    rare = F.when(F.col("a").startswith("gg"), 1).otherwise(2)
    yields = (F.col("wb") > F.col("wa")) & ((F.col("wa.n") <= rare) | (F.col("wb.n") >= 3 * F.col("wa.n")) | (F.col("a").startswith("ff") & (bare("a") == bare("b"))))
    return materialize(met.where(yields).select("a", "b", "wb"), "name-hubs")


def _roots(edges: DataFrame) -> DataFrame:
    """(word, hub): each word with the end of the chain of best supported words that it yields to. Support rises along a
    chain, so it ends."""
    hub = materialize(edges.groupBy("a").agg(F.max("wb").alias("h")).select(F.col("a").alias("word"), F.col("h.word").alias("hub")), "name-roots")
    while True:
        on = hub.join(hub.select(F.col("word").alias("hub"), F.col("hub").alias("top")), "hub", "left")
        if on.where("top is not null").isEmpty():
            return hub
        hub = materialize(on.select("word", F.coalesce("top", "hub").alias("hub")), "name-roots")


def _families(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(family, given, short, root): what a family name stands for beside a given name. Of the words that it may stand for,
    those known with the same given name come first, then the better supported; from there it goes on in the same way, so a
    chain of faults of any length ends at one name."""
    step = edges.where("a like 'ff%'").select(F.substring("a", 3, 1000).alias("at"), F.substring("b", 3, 1000).alias("word"), "wb.n", "wb.t")
    people = rows.where("kind = '' and given <> ''").select(F.col("family").alias("word"), F.substring("given", 1, 1).alias("letter"), F.col("given").alias("full")).distinct()
    key = ["family", "given", "short"]
    begun = rows.join(step.select(F.col("at").alias("family")).distinct(), "family", "left_semi").select(*key, F.col("family").alias("at")).distinct()
    now = materialize(begun.withColumn("open", F.lit(True)), "name-families")
    while not now.where("open").isEmpty():
        met = now.where("open").join(step, "at").withColumn("letter", F.substring(F.concat("given", "short"), 1, 1)).join(people, ["word", "letter"], "left")
        known = F.coalesce(F.when(F.col("given") != "", F.col("full") == F.col("given")).otherwise(F.col("full").startswith(F.col("short"))), F.lit(False))
        best = met.groupBy(*key).agg(F.max(F.struct(known.alias("known"), "n", "t", "word")).alias("best")).select(*key, F.col("best.word").alias("at"))
        on = best.join(step.select("at", F.lit(True).alias("open")).distinct(), "at", "left").select(*key, "at", F.coalesce("open", F.lit(False)).alias("open"))
        now = materialize(now.where("not open").unionByName(on), "name-families")
    return now.select(*key, F.col("at").alias("root"))


def entities(df: DataFrame, column: str) -> DataFrame:
    """(name, entity): every spelling with the person or organisation that it means.

    Given names are corrected to the better supported word within one edit (exact radius join under a true edit metric),
    family names likewise, but to one known with the same given name if there is one; pet forms become the formal name;
    initials and cut-off given names take the full given name of the family that begins with them if there is exactly one
    (given names beside the family name as it stands count first, then those beside its faulty spellings; of several, the
    only one with the same middle initial), and else stand together with those that look the same. Middle initials do not
    part people. Organisations agree in place, field of work and kind. Null and blank names are left out.
    """
    ship_package(df.sparkSession)
    names = materialize(spellings(df, column), "spellings")
    rows = materialize(names.select("name", "times", _parsed("name").alias("p")).select("name", "times", "p.*").where("family <> ''"), "parsed-names")
    rows = materialize(_oriented(rows), "oriented-names")
    edges = _yields(rows)
    givens = _roots(edges.where("a like 'gg%'"))
    rows = rows.withColumn("gw", F.concat(F.lit("gg"), "given")).join(givens.toDF("gw", "gh"), "gw", "left")
    rows = materialize(rows.select("name", "times", "kind", "family", F.coalesce(F.substring("gh", 3, 1000), "given").alias("given"), "short", "middle"), "given-names")
    rows = rows.join(_families(rows, edges), ["family", "given", "short"], "left")
    rows = rows.select("name", "times", "kind", F.coalesce("root", "family").alias("family"), "given", "short", "middle", F.col("root").isNull().alias("own"))
    rows = materialize(rows, "hubbed-names")
    first = lambda c: F.substring(c, 1, 1)
    full = rows.where("given <> '' and kind = ''").groupBy("family", first("given").alias("letter")).agg(
        F.collect_set("given").alias("every"), F.collect_set(F.when(F.col("own"), F.col("given"))).alias("known"), F.collect_set(F.when(F.col("middle") != "", F.concat("given", F.lit(" "), first("middle")))).alias("middles")
    )
    short = rows.where("given = '' and kind = ''").withColumn("letter", first("short")).join(full, ["family", "letter"], "left")
    fits = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda g: g.startswith(F.col("short")))
    short = short.withColumn("known", fits("known")).withColumn("fits", F.when(F.size("known") > 0, F.col("known")).otherwise(fits("every")))
    alike = F.filter("fits", lambda g: F.array_contains("middles", F.concat(g, F.lit(" "), first("middle"))))
    short = short.withColumn("fits", F.when((F.size("fits") > 1) & (F.col("middle") != "") & (F.size(alike) == 1), alike).otherwise(F.col("fits"))).select(
        "name", "kind", "family", F.when((F.size("fits") == 1) & (F.col("short") != ""), F.col("fits")[0]).when(F.size("fits") == 0, F.concat(F.lit("~"), "letter")).otherwise(F.concat(F.lit("?"), "short", F.lit(" "), "middle")).alias("given")
    )
    known = rows.where("given <> '' or kind <> ''").select("name", "kind", "family", "given").unionByName(short)
    return known.select("name", F.concat_ws("|", "kind", "family", "given").alias("entity"))


def variant_pairs(df: DataFrame, column: str) -> DataFrame:
    """(name_a, name_b), name_a before name_b by code point: different spellings of one entity, every pair once."""
    known = materialize(entities(df, column), "name-entities")
    a, b = known.select("entity", F.col("name").alias("name_a")), known.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b")


def entity_classes(df: DataFrame, column: str) -> DataFrame:
    """(name, entity_name, spellings): every spelling, the smallest spelling of its entity, and how many it has. Counted by an
    aggregation that combines before its shuffle and joined back, so no entity's spellings are gathered."""
    known = materialize(entities(df, column), "name-entities")
    by = known.groupBy("entity").agg(F.min("name").alias("entity_name"), F.count(F.lit(1)).alias("spellings"))
    return skew_join(known, by, "entity", "inner").select("name", "entity_name", "spellings")
