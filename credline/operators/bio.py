"""Token-level role/filler tags: ``word@TAG`` with TAG in O, BR:i, IR:i, BF:i, IF:i.

Parser rules reproduced:
* every token must split on ``@`` into exactly two parts and carry a non-empty tag;
* ``O`` is skipped; ``B`` opens a phrase named by the rest of the tag; ``I`` extends the
  open phrase and must repeat its name; ``O`` and unknown tags neither close nor extend;
* role phrases (name holds ``R``) and filler phrases (name holds ``F``) need ``:index``;
* any violation marks the whole row unparsable;
* a role binds the fillers named ``F:<its index>``; a role text seen twice keeps the
  fillers of its last occurrence; filler texts bound to no role are left-overs, distinct
  by text, in order of first appearance.

A row parses inside itself: its tokens are cut at every ``B`` and each piece is looked at once, so
a long text takes linear time (matching sorts its phrases) and no token becomes a row, is sorted or
leaves its task. Steps stand in columns of their own, and a column that a lambda uses is used
outside it too: Spark evaluates an expression that it moves into a lambda once per element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credline.functions.text import tokens

# in a text of tokens joined by single spaces: one without @, with two, or with nothing behind it
BAD_TOKEN = r"(?:^| )[^@ ]++(?: |\z)|@[^@ ]*+@|@(?: |\z)"


def explode_tags(df: DataFrame, id_col: str = "doc_id", tagged: str = "tagged",
                 keep_empty: bool = False) -> DataFrame:
    """One row per token: id, pos, token, word, tag, bio, name, idx, n_parts. With
    ``keep_empty`` a row without tokens (or with a NULL text) keeps one row with NULL
    token fields and ``_null_text`` telling the two apart."""
    gen = F.posexplode_outer if keep_empty else F.posexplode
    t = df.select(id_col, F.col(tagged).isNull().alias("_null_text"),
                  gen(tokens(tagged)).alias("pos", "token"))
    parts = F.split(F.col("token"), "@")
    t = t.withColumn("n_parts", F.size(parts).cast("long"))
    t = t.withColumn("word", parts[0]).withColumn(
        "tag", F.when(F.col("n_parts") == 2, parts[1]))
    t = t.withColumn("bio", F.when(F.col("tag") != "", F.substring("tag", 1, 1)))
    t = t.withColumn("name", F.when(F.col("tag") != "", F.expr("substring(tag, 2)")))
    t = t.withColumn("idx", F.try_element_at(F.split(F.col("name"), ":"), F.lit(2)))
    t = t.withColumn("pos", F.col("pos").cast("long"))
    return t if keep_empty else t.drop("_null_text")


def _pieces(items: str, starts: str) -> Column:
    """The array column ``items`` cut at the 0-based ``starts``."""
    return F.transform(starts, lambda at, j: F.slice(items, at + 1, F.coalesce(F.get(starts, j + 1), F.size(items)) - at))


def _starts(items: str, begins) -> Column:
    """0-based places of the elements for which ``begins(element, place)`` holds."""
    return F.filter(F.transform(items, lambda x, i: F.when(begins(x, i), i)), lambda i: i.isNotNull())


def _runs(df: DataFrame, items: str, key: str, out: str) -> DataFrame:
    """Add ``out``: the sorted array of structs ``items`` cut into runs of equal ``key``."""
    begins = lambda x, i: (i == 0) | (x[key] != F.get(items, i - 1)[key])
    return df.withColumn("_at", _starts(items, begins)).withColumn(out, _pieces(items, "_at")).drop("_at")


def _phrase(piece: Column) -> Column:
    """pos, tag, text and badness of a phrase, from its place and its ``B`` and ``I`` tokens, which
    are known to be well formed."""
    own = piece["own"]
    name = F.substring_index(own[0], "@B", -1)
    other = F.exists(own, lambda x: F.contains(x, F.lit("@I")) & ~F.endswith(x, F.concat(F.lit("@I"), name)))
    needs_idx = name.contains("R") | name.contains("F")
    return F.struct(
        piece["pos"].alias("pos"), name.alias("tag"),
        F.array_join(F.transform(own, lambda x: F.substring_index(x, "@", 1)), " ").alias("text"),
        (other | (needs_idx & ~name.contains(":"))).alias("bad"))


def _parse(df: DataFrame, id_col: str, tagged: str, *keep: str) -> DataFrame:
    """Per row its id, the columns ``keep``, _phrases (pos, tag, text, bad) and _bad (of the whole
    row). The rows are dealt by id once, before any work on the texts."""
    rows = df.select(id_col, *keep, F.col(tagged).alias("_text")).repartition(id_col)
    rows = rows.withColumn("_toks", tokens("_text")).drop("_text")
    fine = ~F.rlike(F.array_join("_toks", " "), F.lit(BAD_TOKEN))
    rows = rows.withColumn("_b", F.when(fine, _starts("_toks", lambda x, _: F.contains(x, F.lit("@B")))))
    is_i = lambda x: F.contains(x, F.lit("@I"))
    head = F.slice("_toks", 1, F.coalesce(F.get("_b", F.lit(0)), F.size("_toks")))
    cut = F.transform("_b", lambda at, j: F.struct(at.cast("long").alias("pos"), F.filter(
        F.slice("_toks", at + 1, F.coalesce(F.get("_b", j + 1), F.size("_toks")) - at), lambda x, i: (i == 0) | is_i(x)).alias("own")))
    rows = rows.select(id_col, *keep, F.transform(cut, _phrase).alias("_phrases"), F.exists(head, is_i).alias("_lost"))
    bad = F.coalesce(F.col("_lost") | F.exists("_phrases", lambda p: p["bad"]), F.lit(True))
    return rows.select(id_col, *keep, "_phrases", bad.alias("_bad"))


def parse_errors(df: DataFrame, id_col: str = "doc_id", tagged: str = "tagged", *keep: str) -> DataFrame:
    """``id, parse_error`` (and the columns ``keep``) for every input row (a NULL text is unparsable)."""
    return _parse(df, id_col, tagged, *keep).select(id_col, *keep, F.col("_bad").alias("parse_error"))


def phrases(df: DataFrame, id_col: str = "doc_id", tagged: str = "tagged") -> DataFrame:
    """Phrases of parsable rows: id, phrase_pos (token position of its ``B``), phrase_tag,
    phrase_text."""
    rows = _parse(df, id_col, tagged).select(id_col, F.explode(F.when(~F.col("_bad"), F.col("_phrases"))).alias("p"))
    return rows.select(id_col, F.col("p.pos").alias("phrase_pos"), F.col("p.tag").alias("phrase_tag"),
                       F.col("p.text").alias("phrase_text"))


def _matches(df: DataFrame, id_col: str, tagged: str) -> DataFrame:
    """id, _groups: per filler tag of a parsable row its entries (key, kind, pos, text), the roles that
    ask for it (kind 0) before the phrases that carry it (kind 1)."""
    rows = _parse(df, id_col, tagged).select(id_col, F.when(~F.col("_bad"), F.col("_phrases")).alias("_ph"))
    entry = lambda key, kind, pos, text: F.struct(
        key.alias("key"), F.lit(kind).alias("kind"), pos.alias("pos"), text.alias("text"))
    rows = rows.select(
        id_col,
        F.sort_array(F.transform(F.filter("_ph", lambda p: p["tag"].contains("R")),
                                 lambda p: F.struct(p["text"], p["pos"], p["tag"]))).alias("_roles"),
        F.transform(F.filter("_ph", lambda p: p["tag"].contains("F")),
                    lambda p: entry(p["tag"], 1, p["pos"], p["text"])).alias("_fills"))
    # a role text seen again takes the fillers of its last occurrence and keeps its first place
    wants = lambda p: F.concat(F.lit("F:"), F.get(F.split(p["tag"], ":"), F.lit(1)))
    roles = F.transform("_same", lambda r: entry(wants(F.element_at(r, -1)), 0, r[0]["pos"], r[0]["text"]))
    rows = _runs(rows, "_roles", "text", "_same").select(id_col, F.sort_array(F.concat(roles, "_fills")).alias("_entries"))
    return _runs(rows, "_entries", "key", "_groups").select(id_col, "_groups")


def bindings(df: DataFrame, id_col: str = "doc_id", tagged: str = "tagged") -> tuple[DataFrame, DataFrame]:
    """(role rows, left-over rows) of parsable rows.

    Role rows: id, role, role_pos, filler, filler_pos (filler NULL for a role without
    fillers). Left-over rows: filler texts that no role took, once each, at their first
    place: id, filler, filler_pos.
    """
    m = _matches(df, id_col, tagged)
    kind = lambda g, k: F.filter(g, lambda e: e["kind"] == k)
    bound = (m.select(id_col, F.explode(F.transform("_groups", lambda g: F.struct(kind(g, 0).alias("r"), kind(g, 1).alias("f")))).alias("g"))
             .select(id_col, F.explode("g.r").alias("r"), F.col("g.f").alias("fills"))
             .select(id_col, "r", F.explode_outer("fills").alias("f"))
             .select(id_col, F.col("r.text").alias("role"), F.col("r.pos").alias("role_pos"),
                     F.col("f.text").alias("filler"), F.col("f.pos").alias("filler_pos")))
    fills = F.flatten(F.transform("_groups", lambda g: F.transform(
        kind(g, 1), lambda e: F.struct(e["text"], e["pos"], (g[0]["kind"] == 0).alias("taken")))))
    texts = _runs(m.select(id_col, F.sort_array(fills).alias("_fillers")), "_fillers", "text", "_same")
    leftover = (texts.select(id_col, F.explode(F.filter("_same", lambda r: ~F.exists(r, lambda x: x["taken"]))).alias("r"))
                .select(id_col, F.col("r")[0]["text"].alias("filler"), F.col("r")[0]["pos"].alias("filler_pos")))
    return bound, leftover
