"""Variant spellings of persons' and bodies' names, linked by a metric-space join.

1. Distinct strings are folded and cut into words; the corpus's own statistics say which
   word is the family name (or a body's own name): the one with fewest distinct partners.
   Rare words are ambiguous and keep both readings; a person's more frequent word is a spare one.
2. The distinct family names are joined within an edit radius. Cells are metric balls: a
   name belongs to every pivot it reaches by at most r deletions. By the triangle
   inequality names sharing a pivot are within 2r, and any two names within r share a
   pivot, so the boundary names are replicated exactly as far as needed. Inside a cell the
   true Damerau-Levenshtein distance decides. (Voronoi cells of sampled pivots do not work here:
   edit distances between names concentrate, and the boundary rule d(x, p) <= d(x, p_x) +
   2r replicates nearly every name to nearly every pivot; the README has the figures.)
3. The distinct given names (and remaining words of bodies) are joined the same way. Forms
   (family name, given name or a body's remaining words, middle initial) meet where both
   names match, so that a very frequent family name alone is never a group.
4. Matching forms become groups by star contraction. Forms with initials only attach
   to one group: the same accents first, then the nearest spelling, an agreeing middle
   initial, the more frequent group. Acronym forms of bodies attach the same way.

Defined results: null and placeholder strings belong to no entity; strings count as they
stand, so two that differ in case or space are two spellings of one entity; an entity
with one spelling gives no pair; repeated rows change only the counts.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.llm.components import connected_groups
from paperloom.session import durable, task_target

#: Stand-ins for unnamed authors, titles, and words that make a name a body's.
PLACEHOLDER = r"(?i)^\W*(et\W+al|and\W+others|others|anonymous|anon|unknown|n/?a|none|null|no author( name)?s?( available)?|not available|not stated|author)?\W*$"
TITLES = frozenset("dr phd md prof professor mr mrs ms sir msc bsc mph rn dphil facp esq".split())
BODY_WORDS = frozenset(
    "group network consortium investigators collaborative collaboration committee society association initiative team "
    "taskforce centre center institute university registry alliance federation council".split()
)
#: Usual shortenings of a body's words.
SHORTENED = {
    "grp": "group", "netw": "network", "net": "network", "cons": "consortium", "consort": "consortium", "invest": "investigators",
    "investig": "investigators", "collab": "collaborative", "wkg": "working", "work": "working", "res": "research",
    "stud": "study", "comm": "committee", "soc": "society", "assoc": "association", "init": "initiative", "inst": "institute",
    "univ": "university", "ctr": "centre", "reg": "registry",
}
LINK_WORDS = frozenset("the for of on and in a behalf".split())
#: Common short forms of given names.
NICKNAMES = {
    "abby": "abigail", "alex": "alexander", "sasha": "alexander", "sandy": "alexander", "andy": "andrew", "toni": "antonia", "tony": "anthony",
    "ben": "benjamin", "benny": "benjamin", "becky": "rebecca", "beth": "elizabeth", "betty": "elizabeth", "lisa": "elizabeth", "liz": "elizabeth",
    "lizzie": "elizabeth", "eliza": "elizabeth", "bill": "william", "billy": "william", "will": "william", "liam": "william",
    "bob": "robert", "bobby": "robert", "rob": "robert", "robbie": "robert", "cathy": "catherine", "charlie": "charles", "chuck": "charles",
    "chris": "christopher", "kit": "christopher", "dan": "daniel", "danny": "daniel", "dave": "david", "debbie": "deborah", "deb": "deborah",
    "dick": "richard", "rick": "richard", "rich": "richard", "ricky": "richard", "mitya": "dimitri", "dima": "dimitri", "lola": "dolores",
    "dora": "theodora", "thea": "theodora", "theo": "theodora", "ted": "edward", "ned": "edward", "ed": "edward", "eddie": "edward",
    "nell": "eleanor", "nora": "eleanor", "ellie": "eleanor", "fina": "josephine", "josie": "josephine", "jo": "josephine",
    "fred": "frederick", "freddie": "frederick", "fritz": "frederick", "rike": "friederike", "frieda": "friederike",
    "gabi": "gabriela", "gaby": "gabriela", "beppe": "giuseppe", "peppe": "giuseppe", "pino": "giuseppe", "hannes": "johannes", "hans": "johannes",
    "hetty": "henrietta", "etta": "henrietta", "iggy": "ignatius", "jackie": "jacqueline", "jim": "james", "jimmy": "james", "jamie": "james",
    "jack": "john", "johnny": "john", "jon": "jonathan", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kitty": "katherine",
    "kostya": "konstantin", "larry": "lawrence", "laurie": "lawrence", "lena": "magdalena", "magda": "magdalena", "leni": "magdalena",
    "leo": "leonardo", "nardo": "leonardo", "maggie": "margaret", "meg": "margaret", "peggy": "margaret", "greta": "greta",
    "hias": "matthias", "matze": "matthias", "matt": "matthew", "mike": "michael", "mick": "michael", "mickey": "michael",
    "mina": "wilhelmina", "willa": "wilhelmina", "minna": "wilhelmina", "natasha": "natalia", "nat": "natalia", "nick": "nicholas",
    "niko": "nikolaus", "klaus": "nikolaus", "ollie": "oliver", "paco": "francisco", "pancho": "francisco", "frank": "francis",
    "pat": "patricia", "patty": "patricia", "trish": "patricia", "tricia": "patricia", "pete": "peter", "pippa": "philippa", "phil": "philip",
    "sam": "samuel", "sammy": "samuel", "steffi": "stephanie", "steph": "stephanie", "steve": "stephen", "sue": "susanna", "susi": "susanna",
    "susie": "susanna", "suzy": "susanna", "tina": "valentina", "vale": "valentina", "tom": "thomas", "tommy": "thomas", "uschi": "ursula",
    "ulla": "ursula", "vicky": "victoria", "vic": "victoria", "tori": "victoria", "zak": "zachary", "zach": "zachary", "zack": "zachary",
}
PLAIN = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "’": "'", "`": "'"})

MAX_RADIUS = 2
#: A word with more times the mean number of distinct partners than this, and several times its neighbour's, is a family name in a spare reading only.
COMMON_WORD = 10

_WORDS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")


def fold(text: str) -> str:
    """Lower case without accents."""
    plain = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).casefold().translate(PLAIN))
    return "".join(c for c in plain if not unicodedata.combining(c)).translate(PLAIN)


def cut_name(name: str) -> tuple[bool, list[str], list[str], list[int], list[str], str]:
    """(is a body, full words folded, the same as spelt in NFC lower case, their hyphenated units, initials, acronym) of a name."""
    text = unicodedata.normalize("NFKC", name)
    text = re.sub(r"(?<=[^\W\d_])0(?=[^\W\d_]|\b)", "o", re.sub(r"(?<=[^\W\d_])1(?=[^\W\d_]|\b)", "l", text))
    acronym = ""
    if m := re.search(r"\(([^)]*)\)", text):
        text = text[: m.start()] + " " + text[m.end() :]
    head, comma, tail = text.partition(",")
    if comma:
        title_only = all(w.casefold() in TITLES for w in _WORDS.findall(tail.replace(".", "")))
        text = head if title_only else tail + " " + head
    words, spelt, units, initials = [], [], [], []
    found = [m for m in _WORDS.finditer(text) if fold(m.group()) not in TITLES or re.fullmatch("[A-Z]{2}", m.group())]
    raw = [m.group() for m in found]
    unit, last = 0, -1
    letters = sum(len(w) > 1 and w.isupper() for w in raw)
    shouted = letters == len([w for w in raw if len(w) > 1]) and letters > 1
    for m, w in zip(found, raw, strict=True):
        f = fold(w)
        unit += not (m.start() == last + 1 and text[last] in "-\u2010\u2011")
        last = m.end()
        if len(w) == 1:
            initials.append(f)
        elif w.isupper() and len(w) <= 4 and not shouted and len(raw) > 1:
            acronym = f
            if len(w) <= 3:
                initials += list(f)
        else:
            words.append(f)
            spelt.append(unicodedata.normalize("NFC", w.casefold()))
            units.append(unit)
    full = [SHORTENED.get(w, w) for w in words]
    if any(w in BODY_WORDS for w in full):
        keep = [i for i, w in enumerate(full) if w not in LINK_WORDS]
        return True, [full[i] for i in keep], [spelt[i] for i in keep], keep, [], ""
    return False, words, spelt, units, initials, acronym


CUT = "body boolean, words array<string>, spelt array<string>, units array<int>, initials array<string>, acronym string"


def _cut(names: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([cut_name(n) for n in names], columns=["body", "words", "spelt", "units", "initials", "acronym"])


def radius(length: Column) -> Column:
    """The edit radius for a word of so many letters."""
    return F.when(length <= 3, 0).when(length <= 5, 1).otherwise(MAX_RADIUS)


def _deletions(words: Column) -> Column:
    """Every string one deletion away from one of ``words``, and those themselves."""
    shorter = F.flatten(
        F.transform(
            words,
            lambda w: F.transform(
                F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))),
                lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))),
            ),
        )
    )
    return F.array_distinct(F.concat(words, shorter))


def pivots(word: Column) -> Column:
    """The pivots a word belongs to: what at most its radius of deletions leaves."""
    r = radius(F.length(word))
    own = F.array(word)
    return F.when(r == 0, own).when(r == 1, _deletions(own)).otherwise(_deletions(_deletions(own)))


def damerau(a: str, b: str) -> int:
    """The unrestricted Damerau-Levenshtein distance, a metric in which a swap of neighbours is one edit."""
    last: dict[str, int] = {}
    far = len(a) + len(b)
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i in range(1, len(a) + 1):
        match = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), match
            cost = a[i - 1] != b[j - 1]
            if not cost:
                match = j
            d[i + 1][j + 1] = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[len(a) + 1][len(b) + 1]


def _with_swaps(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([damerau(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def near_words(words: DataFrame, word: str) -> DataFrame:
    """(a, b, d): ordered pairs of distinct words within the radius of the shorter one, and each with itself."""
    cells = words.select(F.col(word).alias("w")).distinct().select("w", F.explode(pivots(F.col("w"))).alias("pivot"))
    left, right = cells.withColumnRenamed("w", "a"), cells.withColumnRenamed("w", "b")
    # exploded rows: the size of the files says nothing, so no side may be taken for small
    both = left.join(right.hint("merge"), "pivot").where((F.col("a") <= F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= MAX_RADIUS))
    pairs = durable(both.select("a", "b").distinct().withColumn("d", F.levenshtein("a", "b")).where(F.col("d") <= 2 * MAX_RADIUS))
    # a swap costs Levenshtein two: a pair that can hold one is measured by the true metric in Python, whatever its length
    letters = lambda c: F.array_sort(F.split(F.col(c), ""))
    left_over = F.size(F.array_except(letters("a"), letters("b"))) + F.size(F.array_except(letters("b"), letters("a")))
    swap = F.when(F.col("d") == 3, left_over <= 2).otherwise((F.col("d") > 1) & (letters("a") == letters("b")))
    swaps = pairs.where(swap).repartition(task_target(words.sparkSession)).withColumn("d", F.pandas_udf(_with_swaps, "int")("a", "b"))
    pairs = pairs.where(~swap).unionByName(swaps).where(F.col("d") <= radius(F.least(F.length("a"), F.length("b"))))
    return pairs.unionByName(pairs.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))


def name_forms(names: DataFrame) -> DataFrame:
    """(name, n, body, sur, spelt, given, initials, acronym): the readings of each distinct name."""
    cut = durable(names.select("name", "n", F.pandas_udf(_cut, CUT)("name").alias("c")).select("name", "n", "c.*").where(F.size("words") > 0))
    long = cut.select("name", F.posexplode(F.arrays_zip("words", "spelt", "units")).alias("at", "w")).select("name", "at", "w.words", "w.spelt", "w.units")
    several = cut.where(F.size("words") > 1)
    partners = (
        several.select(F.explode("words").alias("word"), F.col("words").alias("all"))
        .select("word", F.explode("all").alias("other"))
        .where("word <> other")
        .distinct()
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("degree"))
    )
    weighed = long.join(partners, long["words"] == partners["word"], "left").select(
        "name", F.struct(F.col("words").isin(*BODY_WORDS, *SHORTENED.values()).alias("kind"), F.coalesce("degree", F.lit(0)).alias("degree"), (-F.length("words")).alias("short"), "at", F.col("words").alias("word"), "spelt", F.col("units").alias("unit")).alias("w")
    )
    ranked = weighed.groupBy("name").agg(F.array_sort(F.collect_list("w")).alias("by_degree"))  # a name's own words
    mean = partners.agg(F.coalesce(F.avg("degree"), F.lit(0.0)).alias("mean_degree"))  # one row
    rows = cut.join(ranked, "name").join(F.broadcast(mean))
    first, second = F.get("by_degree", F.lit(0)), F.get("by_degree", F.lit(1))
    frequent = second["degree"] > F.greatest(first["degree"] * 3, F.col("mean_degree") * COMMON_WORD)
    open_order = (F.size("by_degree") > 1) & ~second["kind"] & (~frequent | (~F.col("body") & (first["unit"] != second["unit"])))
    reading = lambda word, spare: F.struct(word.alias("s"), F.coalesce(spare, F.lit(False)).alias("spare"))
    readings = F.when(open_order, F.array(reading(first, F.lit(False)), reading(second, frequent))).otherwise(F.array(reading(first, F.lit(False))))
    out = rows.select("name", "n", "body", "words", "units", "initials", "acronym", F.explode(readings).alias("r")).select("*", "r.s", "r.spare")
    others = F.filter(F.arrays_zip("words", "units"), lambda w: (w["words"] != F.col("s.word")) & (F.col("body") | (w["units"] != F.col("s.unit"))))
    rest = F.transform(others, lambda w: w["words"])
    return out.select(
        "name",
        "n",
        "body",
        F.col("s.word").alias("sur"),
        F.col("s.spelt").alias("spelt"),
        F.when(F.col("body"), F.array_join(F.array_sort(F.array_distinct(rest)), " ")).otherwise(F.coalesce(F.get(rest, F.lit(0)), F.lit(""))).alias("given"),
        "initials",
        "acronym",
        "spare",
    )


def formal_given(given: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in NICKNAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, given), given)


def entity_spellings(names: DataFrame) -> DataFrame:
    """(name, entity) for the distinct names of (name, n); a name has one entity or none."""
    forms = name_forms(names.where(F.col("name").isNotNull() & ~F.col("name").rlike(PLACEHOLDER)))
    middle = F.when(F.col("given") == "", F.coalesce(F.get("initials", F.lit(1)), F.lit(""))).otherwise(F.coalesce(F.get("initials", F.lit(0)), F.lit("")))
    forms = forms.select(
        "name", "n", "body", "sur", "spelt", "spare",
        F.when(F.col("body"), F.col("given")).otherwise(formal_given(F.col("given"))).alias("given"),
        F.coalesce(F.get("initials", F.lit(0)), F.lit("")).alias("first"),
        F.when(F.col("body"), "").otherwise(middle).alias("middle"),
        F.array_join(F.array_sort(F.split(F.coalesce("acronym", F.lit("")), "")), "").alias("acronym"),
    )
    kind = F.when(F.col("body"), "body").when(F.col("given") == "", "initials").otherwise("person")
    forms = durable(forms.withColumn("kind", kind).withColumn("form", F.xxhash64("kind", "sur", "given", "first", "middle", "acronym", "spelt")))
    near = durable(near_words(forms, "sur"))
    whole = forms.where("kind <> 'initials'").groupBy("form", "kind", "sur", "given", "middle", "spelt").agg(F.sum("n").alias("n"))
    whole = durable(whole)
    given = durable(near_words(whole, "given"))
    side = lambda c: whole.select(F.col("form").alias(c), "kind", F.col("sur").alias(f"sur_{c}"), F.col("given").alias(f"given_{c}"), F.col("middle").alias(f"middle_{c}"))
    # both names of a form are looked up among the distinct names, so a frequent one meets its few neighbours and never a block of forms
    left = side("a").join(near.select(F.col("a").alias("sur_a"), F.col("b").alias("sur_b")).hint("merge"), "sur_a")
    left = left.join(given.select(F.col("a").alias("given_a"), F.col("b").alias("given_b")).hint("merge"), "given_a")
    met = left.join(side("b").hint("merge"), ["kind", "sur_b", "given_b"])
    agree = (F.col("a") < F.col("b")) & ((F.col("middle_a") == "") | (F.col("middle_b") == "") | (F.col("middle_a") == F.col("middle_b")))
    links = met.where(agree).select("a", "b").distinct()
    grouped = connected_groups(links)
    anchored = whole.join(grouped, whole["form"] == grouped["id"], "left").select("form", "kind", "sur", "spelt", "given", "middle", "n", F.coalesce("group_id", "form").alias("entity"))
    anchored = durable(anchored)
    attached = _attach_initials(forms, anchored, near)
    by_form = anchored.select("form", "entity", F.col("n").alias("weight")).unionByName(attached)
    placed = durable(forms.join(by_form, "form").select("name", "entity", "weight", "spare"))
    # a name of two readings takes the one whose entity has more spellings
    usual = placed.where("not spare")
    size = usual.groupBy("entity").agg(F.count_distinct("name").alias("spellings"))
    best = durable(usual.join(size, "entity").groupBy("name").agg(F.max(F.struct("spellings", "weight", "entity")).alias("m")).select("name", F.col("m.entity").alias("entity")))
    return best.join(_wider(best, placed), "entity", "left").select("name", F.coalesce("wider", "entity").alias("entity"))


def _wider(best: DataFrame, placed: DataFrame) -> DataFrame:
    """(entity, wider): the entities whose names all have a spare reading in one larger entity; so none is torn apart."""
    spare = placed.where("spare").select("name", F.col("entity").alias("wider")).distinct()
    held = best.groupBy("entity").agg(F.count(F.lit(1)).alias("names"))
    whole = best.join(spare, "name").groupBy("entity", "wider").agg(F.count(F.lit(1)).alias("shared")).join(held, "entity").where("shared = names and wider <> entity")
    size = placed.groupBy(F.col("entity").alias("wider")).agg(F.count_distinct("name").alias("spellings"))
    larger = whole.join(size, "wider").where("spellings > names")
    return larger.groupBy("entity").agg(F.max(F.struct("spellings", "wider")).alias("m")).select("entity", F.col("m.wider").alias("wider"))


def _attach_initials(forms: DataFrame, anchored: DataFrame, near: DataFrame) -> DataFrame:
    """(form, entity, weight) of the forms that have a family name and initials or an acronym only."""
    short = forms.where("kind = 'initials'").groupBy("form", "sur", "spelt", "first", "middle", "acronym").agg(F.sum("n").alias("n"))
    total = Window.partitionBy("entity")
    letters = F.array_join(F.array_sort(F.transform(F.split("given", " "), lambda w: F.substring(w, 1, 1))), "")
    target = anchored.select(
        "entity", F.col("kind").alias("kind_t"), F.col("sur").alias("sur_t"), F.col("spelt").alias("spelt_t"), F.col("middle").alias("middle_t"),
        F.when(F.col("kind") == "body", letters).otherwise(F.substring("given", 1, 1)).alias("letter"),
        F.sum("n").over(total).alias("weight"),
    )
    target = target.groupBy("entity", "kind_t", "sur_t", "spelt_t", "middle_t", "letter").agg(F.max("weight").alias("weight"))
    ways = short.select("*", F.lit("person").alias("kind_t"), F.col("first").alias("letter")).where("first <> ''").unionByName(
        short.select("*", F.lit("body").alias("kind_t"), F.col("acronym").alias("letter")).where("acronym <> ''")
    )
    met = ways.join(near.select(F.col("a").alias("sur"), F.col("b").alias("sur_t"), "d"), "sur").join(target, ["sur_t", "kind_t", "letter"])
    fits = (F.col("kind_t") == "body") | (F.col("middle") == "") | (F.col("middle_t") == "") | (F.col("middle") == F.col("middle_t"))
    score = F.struct(
        (F.col("kind_t") == "body").alias("body"),
        (F.col("spelt") == F.col("spelt_t")).alias("same"),
        (-F.col("d")).alias("close"),
        ((F.col("middle") != "") & (F.col("middle") == F.col("middle_t"))).alias("middle"),
        "weight",
        "entity",
    )
    placed = met.where(fits).groupBy("form").agg(F.max(score).alias("s")).select("form", F.col("s.entity").alias("entity"), F.col("s.weight").alias("weight"))
    alone = short.join(placed, "form", "left_anti")
    # without a full name to attach to, forms of one family name and first initial are one person
    return placed.unionByName(alone.select("form", F.xxhash64(F.lit("alone"), "sur", "first").alias("entity"), F.col("n").alias("weight")))


def spelling_pairs(spellings: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a before name_b in code point order: two spellings of one entity."""
    a = spellings.select("entity", F.col("name").alias("name_a"))
    b = spellings.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where(F.col("name_a") < F.col("name_b")).select("name_a", "name_b").distinct()


def author_names(papers: DataFrame, column: str = "authors") -> DataFrame:
    """(name, n): the distinct elements of a column of lists."""
    return papers.select(F.explode(column).alias("name")).where(F.col("name").isNotNull()).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
