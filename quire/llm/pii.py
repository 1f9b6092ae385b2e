"""Personal data: patterns, and information-theoretic sanitisation of the terms that reveal them.

Base spans are e-mail addresses, IP addresses, payment cards and telephone numbers.  Each distinct
value is a protected entity, however many texts hold it; documents of one text count once.  A term
that occurs beside an entity discloses, of the entity's information log2(1 / p(e)), the share
log2(p(e|t) / p(e)).  A term that discloses at least ``DISCLOSED`` of an entity, in at least
``CONTEXTS`` different contexts (the words before and after, so copies of one passage count once), is
a span wherever it stands in a text that holds the entity, and is generalised like the base spans.

Entities that the same texts hold have the same statistics, so words are counted beside such classes
of entities: a text with a thousand addresses of its own counts its words once.

Everything is DataFrame expressions.  The patterns find what the plain ones do, written so that they
run in linear time and constant stack: a match begins at the start of a run of its characters or
where the last one ended, and repetition never gives back.

Null and empty texts have no spans; an empty table gives no rows.  Very long texts are read whole.
Documents are known by doc_id and a hash of their text, so repeated rows and repeated or null ids each
keep their own result.  Ties: a term exactly at a limit counts.  Offsets are code points, ends
exclusive.  Other columns are passed through or ignored, whatever their names; names that begin with
``__pii`` are reserved.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scratch

#: Share of an entity's information, and contexts, from which a term is sanitised.
DISCLOSED, CONTEXTS = 0.8, 3
#: Texts with copies up to which their hashes (16 bytes each) are broadcast; more are joined by sorting.
COPIED = 1_000_000
#: Parts into which the documents of one text are dealt when its spans are joined.
SALT = 16
KINDS = ("email", "ip", "card", "phone")
#: The patterns, and a test that a text must pass to hold a match at all.
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
TERM = r"\p{L}{3,}+"
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.length(F.ltrim(F.lit("0"), p)) <= 3) & F.forall(F.split(m, r"\."), lambda p: F.coalesce(F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int"), F.lit(0)) <= 255)
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(8, 15)
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    digit = lambda i: F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, doubled(digit(i))).otherwise(digit(i)))
    # short and long runs are settled before digits are summed
    return F.when(F.length(digits).between(16, 19), total % 10 == 0).otherwise(False)


#: Spans that one array grows by; a longer list is worked out in runs of so many, each from where the one before ends.
RUN = 128


def _runs(n: Column) -> Column:
    """The first places of the runs of n items."""
    return F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1, F.lit(RUN))


def _of_run(a: Column, n: Column) -> Column:
    return F.sequence(a, F.least(a + RUN, n) - 1)


def _carried(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """What the values before each one come to, from 0 on; a value a run, so the array is short."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(values, start, lambda acc, v: F.struct(join(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def _spans(kind: str, gaps: Column, found: Column) -> Column:
    """Spans of the matches ``found`` in order: lengths of the pieces between them, ``gaps``, give their places."""
    n = F.size(found)
    width = lambda i: F.length(F.get(gaps, i)) + F.length(F.get(found, i))
    totals = F.transform(_runs(n), lambda a: F.aggregate(_of_run(a, n), F.lit(0), lambda t, i: t + width(i)))

    def step(acc: Column, i: Column) -> Column:
        m = F.get(found, i)
        begin = acc["at"] + F.length(F.get(gaps, i))
        end = begin + F.length(m)
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), m.alias("value"))
        return F.struct(end.alias("at"), F.when(_valid(kind, m), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def run(x: Column) -> Column:
        return F.aggregate(_of_run(x["a"], n), F.struct(x["at"].alias("at"), F.array().cast(SPAN).alias("out")), step, lambda acc: acc["out"])

    each = F.arrays_zip(_runs(n).alias("a"), _carried(totals, lambda at, v: at + v).alias("at"))
    return F.when(n > 0, F.flatten(F.transform(each, run))).otherwise(F.array().cast(SPAN))


def base_spans(docs: DataFrame) -> DataFrame:
    """Columns doc_id, h (a hash of the text), given (whether there is a text), text (null: empty), spans in the order of KINDS and places."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").isNotNull().alias("given"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("h", F.xxhash64("text"))
    none = F.array().cast("array<string>")
    for kind, (pattern, holds) in PATTERNS.items():
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        if kind == "card":
            found = F.filter(found, lambda m: F.lit(True))
        d = d.withColumn(f"m_{kind}", F.when(F.contains("text", F.lit(holds)), found).otherwise(none) if holds else found)
    # cards: only texts with a run of 16 digits are cut at their matches
    long_run = F.exists("m_card", lambda m: F.length(m) >= 16)
    d = d.withColumn("m_card", F.when(long_run, F.col("m_card")).otherwise(none))
    # a text without matches is not cut; the pieces are a column, as a function of them would cut the text for each
    for kind, (pattern, _) in PATTERNS.items():
        d = d.withColumn(f"g_{kind}", F.when(F.size(f"m_{kind}") > 0, F.split("text", pattern, -1)).otherwise(none))
    for kind in PATTERNS:
        d = d.withColumn(f"s_{kind}", _spans(kind, F.col(f"g_{kind}"), F.col(f"m_{kind}")))
    return d.select("doc_id", "h", "given", "text", F.concat(*[F.col(f"s_{k}") for k in KINDS]).alias("spans"))


def entity(span: Column) -> Column:
    """The entity that a span's value names: addresses in lower case, numbers by their digits."""
    kind, value = span["kind"], span["value"]
    return F.concat(kind, F.lit(":"), F.when(kind.isin("card", "phone"), F.regexp_replace(value, "[^0-9]", "")).otherwise(F.lower(value)))


def terms_of(text: Column) -> Column:
    """The words of a text, in lower case, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


CLASS = ["held", "x1", "x2"]


def entity_classes(once: DataFrame) -> DataFrame:
    """Columns h and CLASS: the classes of each text's entities; ``once`` has a row (h, entities) for each text that holds any.

    A class is known by the number of texts that hold it and two combined hashes of them.
    """
    holds = once.select("h", F.explode("entities").alias("entity"))
    by_entity = holds.groupBy("entity").agg(F.count(F.lit(1)).alias("held"), F.bit_xor("h").alias("x1"), F.bit_xor(F.xxhash64("h", F.lit(7))).alias("x2"))
    return holds.join(by_entity, "entity").select("h", *CLASS).distinct()


def disclosing_terms(once: DataFrame, classes: DataFrame, base: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Columns CLASS, term: terms that disclose the entities of a class; documents of one text count once.

    ``once`` has h and text of each text with entities, ``base`` h and given of all documents.
    """
    by_hash = base.where("given").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    texts, many = by_hash.agg(F.count(F.lit(1)), F.count_if(F.col("n") > 1)).first()
    copies = by_hash.where("n > 1")
    own = once.join(classes.groupBy("h").agg(F.collect_list(F.struct(*CLASS)).alias("classes")), "h")
    # outer generators: of an inner one Spark tests the size first, by working out the words again
    own = own.select("h", "classes", terms_of(F.col("text")).alias("w"))
    in_context = F.expr("transform(sequence(1, greatest(size(w), 1)), i -> struct(get(w, i - 1) as term, xxhash64(coalesce(get(w, i - 2), ''), coalesce(get(w, i), '')) as ctx))")
    seen = own.select(F.explode_outer("classes").alias("c"), in_context.alias("w")).select("c.*", F.inline_outer("w"))
    by_context = seen.distinct().groupBy(*CLASS, "term").agg(F.count(F.lit(1)).alias("contexts")).where(F.col("contexts") >= CONTEXTS)
    beside = own.select(F.explode_outer("classes").alias("c"), F.array_distinct("w").alias("w")).select("c.*", F.explode_outer("w").alias("term"))
    by_text = beside.groupBy(*CLASS, "term").agg(F.count(F.lit(1)).alias("together"))
    both = scratch.keep(by_text.join(by_context, [*CLASS, "term"], "left_semi"), "together")
    # how many texts of the whole corpus hold each candidate term: rows of a text with n copies count one nth each
    every = docs.where("text is not null").select(F.xxhash64("text").alias("h"), F.array_distinct(terms_of(F.col("text"))).alias("w"))
    every = every.join(F.broadcast(copies) if many <= COPIED else copies.hint("merge"), "h", "left").select(F.coalesce("n", F.lit(1)).alias("n"), F.explode_outer("w").alias("term"))
    # counted before the join, so that what moves is a task's distinct terms, at every size
    spread = every.groupBy("term", "n").agg(F.count(F.lit(1)).alias("rows")).join(both.select("term").distinct().hint("merge"), "term", "left_semi")
    spread = spread.groupBy("term").agg(F.sum(F.expr("rows div n")).alias("spread"))
    p_e = F.col("held") / F.lit(texts)
    p_et = F.col("together") / F.col("spread")
    # entities of all texts have no information to disclose
    out = both.where(F.col("held") < texts).join(spread, "term").where(F.log2(p_et / p_e) / F.log2(1 / p_e) >= DISCLOSED)
    return out.select(*CLASS, "term")


def term_spans(once: DataFrame, named: DataFrame) -> DataFrame:
    """Columns h, terms (spans in order): where the terms that ``named`` (h, term) gives stand in the texts of ``once`` (h, text)."""
    marked = once.join(named.groupBy("h").agg(F.collect_set("term").alias("named")), "h")
    words, gaps = F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.split("text", TERM, -1)
    marked = marked.select("h", "named", F.arrays_zip(words.alias("word"), F.slice(gaps, 1, F.size(gaps) - 1).alias("gap")).alias("z"))
    # of each word only its length moves on, and the word itself where it is named
    steps = F.expr("transform(z, x -> struct(length(x.gap) + length(x.word) as step, if(array_contains(named, lower(x.word)), x.word, null) as value))")
    cut = marked.select("h", F.posexplode_outer(steps).alias("pos", "x")).select("h", "pos", "x.*")
    # a word ends at the sum of all gaps and words up to it
    cut = cut.withColumn("end", F.expr("sum(step) over (partition by h order by pos)").cast("int")).where("value is not null")
    span = F.struct((F.col("end") - F.length("value")).alias("start"), "end", "value")
    found = cut.groupBy("h").agg(F.sort_array(F.collect_list(span)).alias("l"))
    return found.select("h", F.transform("l", lambda x: F.struct(F.lit("term").alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"))).cast(SPAN).alias("terms"))


def find(docs: DataFrame) -> DataFrame:
    """Columns doc_id, h, base (spans of the patterns), terms (spans of disclosing terms)."""
    scratch = Scratch(docs.sparkSession, "pii")
    base = base_spans(docs)
    base = scratch.keep(base.select("doc_id", "h", "given", "spans", F.when(F.size("spans") > 0, F.col("text")).alias("text")), "base")
    once = base.where("text is not null").select("h", "text", F.array_distinct(F.transform("spans", entity)).alias("entities")).dropDuplicates(["h"])
    once = scratch.keep(once, "once")
    classes = entity_classes(once)
    terms = disclosing_terms(once.select("h", "text"), classes, base.select("h", "given"), docs, scratch)
    named = classes.join(terms, CLASS).select("h", "term").distinct()
    found = term_spans(once.select("h", "text"), named)
    # the documents of one text are dealt to SALT tasks, each of which gets the text's spans
    found = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    out = base.select("doc_id", "h", "spans", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int").alias("salt")).join(found, ["h", "salt"], "left")
    return out.select("doc_id", "h", F.col("spans").alias("base"), F.coalesce("terms", F.array().cast(SPAN)).alias("terms"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """Columns doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of each document."""
    found = find(docs)
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "terms")).alias("spans"))


def generalised(docs: DataFrame, text: str, spans: str) -> DataFrame:
    """The column ``text`` with each of its ``spans``, or overlapping group of them, replaced by the kind of its first, in brackets.

    The text is taken apart as code points of four bytes, where a place is found without counting characters.
    """
    order, code, n = f"__{text}_order", f"__{text}_code", F.size(f"__{text}_order")
    listed_ = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    d = docs.withColumns({order: listed_, code: F.when(F.size(spans) > 0, F.encode(text, "UTF-32"))})
    at = lambda i: F.get(order, i)
    furthest = F.transform(_runs(n), lambda a: F.aggregate(_of_run(a, n), F.lit(0), lambda t, i: F.greatest(t, at(i)["end"])))
    kind = "array<struct<at:int,start:int,kind:string>>"

    def step(acc: Column, i: Column) -> Column:
        s = at(i)
        mark = F.struct(acc["at"].alias("at"), s["start"].alias("start"), s["kind"].alias("kind"))
        # a span that begins before the one before it ends goes with that
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(mark))).otherwise(acc["out"]).alias("out"))

    def run(x: Column) -> Column:
        return F.aggregate(_of_run(x["a"], n), F.struct(x["at"].alias("at"), F.array().cast(kind).alias("out")), step, lambda acc: acc["out"])

    each = F.arrays_zip(_runs(n).alias("a"), _carried(furthest, F.greatest).alias("at"))
    # a mark before the bytes, as a text may begin with the character that is one
    cut = lambda a, many: F.decode(F.concat(F.lit(bytes([0, 0, 0xFE, 0xFF])), F.substring(code, 4 * a + 1, 4 * many)), "UTF-32")
    pieces = F.transform(F.flatten(F.transform(each, run)), lambda m: F.concat(cut(m["at"], m["start"] - m["at"]), F.lit("["), F.upper(m["kind"]), F.lit("]")))
    last = F.aggregate(F.col(order), F.lit(0), lambda t, s: F.greatest(t, s["end"]))
    rest = cut(last, F.greatest(F.length(text) - last, F.lit(0)))
    return d.withColumn(text, F.when(F.col(code).isNotNull(), F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col(text))).drop(order, code)


def sanitised(docs: DataFrame) -> DataFrame:
    """The documents with personal data and disclosing terms generalised; n_chars follows the text."""
    found = find(docs).where((F.size("base") > 0) | (F.size("terms") > 0)).dropDuplicates(["doc_id", "h"])
    found = found.select(F.col("doc_id").alias("__pii_i"), F.col("h").alias("__pii_g"), F.concat("base", "terms").alias("__pii_spans"))
    keyed = docs.withColumns({"__pii_id": F.col("doc_id").cast("long"), "__pii_h": F.xxhash64(F.coalesce("text", F.lit("")))})
    out = keyed.join(found, F.col("__pii_id").eqNullSafe(F.col("__pii_i")) & (F.col("__pii_h") == F.col("__pii_g")), "left")
    out = generalised(out, "text", "__pii_spans")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return out.drop("__pii_id", "__pii_h", "__pii_i", "__pii_g", "__pii_spans")
