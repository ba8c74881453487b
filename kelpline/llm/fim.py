"""Fill-in-middle: texts cut at unit boundaries into prefix, middle and suffix, and put together anew.

Relational: a text's units are the matches of a pattern, left to right, whose
lengths become rows (``posexplode``) with running sums of lengths in a window;
the two cuts of a text are requests for unit ordinals, joined with the rows and
aggregated to two offsets a text; then the parts are substrings.  Cuts and form
are hashes of the id, never a generator's state.

A text and its id are one key (id and digest), so repeated rows are cut once
and share the offsets; only lengths are exploded and shuffled, a text moves
once, to meet its offsets.  That join is Spark's, which splits a key of many
equal rows at run time.

Null text is empty, a null id counts as the empty string; texts without units or
with a marker in them stay as they are (form ``plain``). Repeated rows keep a
row each; long texts are taken whole (a text's units are one window). Columns
named ``n``, ``form``, ``prefix_chars``, ``middle_chars`` or ``output`` are
replaced, others kept. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpline.llm.store import table

LINES = r"[^\n]*\n|[^\n]+"
P, S, M = "<P>", "<S>", "<M>"
NEW = ("n", "form", "prefix_chars", "middle_chars", "output")
_KEY = ["key_id", "key_text"]


def draws(ident: Column, seed: str) -> list[Column]:
    """Four unsigned 32-bit numbers of an id: the first groups of its seeded SHA-256."""
    h = F.sha2(F.concat(F.lit(seed), ident), 256)
    return [F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def offsets(keyed: DataFrame, text: str, *, unit: str, seed: str) -> DataFrame:
    """key, n (units), prefix and upto: the code points before the first and the second cut."""
    lengths = F.transform(F.regexp_extract_all(F.col(text), F.lit(unit), 0), F.length)
    units = keyed.select(*_KEY, lengths.alias("lengths")).groupBy(*_KEY).agg(F.first("lengths").alias("lengths"))
    n = F.size("lengths").cast("long")
    h1, h2, _, _ = draws(F.col("key_id"), seed)
    requests = units.select(*_KEY, n.alias("n"), F.least(h1 % (n + 1), h2 % (n + 1)).alias("first"), F.greatest(h1 % (n + 1), h2 % (n + 1)).alias("second"))
    places = units.select(*_KEY, F.posexplode("lengths").alias("at", "length"))
    ends = places.select(*_KEY, (F.col("at") + 1).alias("ordinal"), F.sum("length").over(Window.partitionBy(*_KEY).orderBy("at")).alias("end"))
    asked = requests.alias("r").join(ends.alias("e"), [F.col(f"r.{k}") == F.col(f"e.{k}") for k in _KEY] + [F.col("ordinal").isin(F.col("first"), F.col("second"))], "left")
    upto = lambda cut: F.coalesce(F.max(F.when(F.col("ordinal") == F.col(cut), F.col("end"))), F.lit(0)).cast("int")
    return asked.groupBy(*[F.col(f"r.{k}").alias(k) for k in _KEY], "n").agg(upto("first").alias("prefix"), upto("second").alias("upto"))


def transformed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit: str = LINES, seed: str = "7:", rate: int = 100, spm: int = 50) -> DataFrame:
    """``docs`` with n, form (plain, psm or spm), prefix_chars, middle_chars and output; ``rate`` and ``spm`` in percent."""
    kept = [c for c in docs.columns if c.lower() not in NEW]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("whole"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("key_id"))
    rows = rows.withColumn("key_text", F.coalesce(F.unhex(F.sha2("whole", 256)), F.lit(b"")))  # never null, so no filter hashes it again
    found = rows.join(offsets(rows, "whole", unit=unit, seed=seed).hint("shuffle_hash"), _KEY)
    _, _, h3, h4 = draws(F.col("key_id"), seed)
    marked = F.contains("whole", F.lit(P)) | F.contains("whole", F.lit(S)) | F.contains("whole", F.lit(M))
    form = F.when((F.col("whole") == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    found = found.withColumn("form", form)
    one = lambda c: F.when(F.col("form") != "plain", c)
    prefix, middle = F.substring("whole", F.lit(1), F.col("prefix")), F.substring("whole", F.col("prefix") + 1, F.col("upto") - F.col("prefix"))
    suffix = F.substring("whole", F.col("upto") + 1, F.length("whole"))
    output = F.when(F.col("form") == "psm", F.concat(F.lit(P), prefix, F.lit(S), suffix, F.lit(M), middle)).when(F.col("form") == "spm", F.concat(F.lit(S), suffix, F.lit(P), prefix, F.lit(M), middle)).otherwise(F.col("whole"))
    chars = [one(F.col("prefix").cast("long")).alias("prefix_chars"), one((F.col("upto") - F.col("prefix")).cast("long")).alias("middle_chars")]
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], "n", "form", *chars, output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that became ``output``: markers of a text that isn't plain stand nowhere else."""
    end = F.length(output)

    def three(first: str, second: str) -> tuple[Column, Column, Column]:
        a = F.position(F.lit(first), output)
        b = F.position(F.lit(second), output)
        return F.substring(output, F.lit(4), a - 4), F.substring(output, a + 3, b - a - 3), F.substring(output, b + 3, end)

    prefix, suffix, middle = three(S, M)
    suffix2, prefix2, middle2 = three(P, M)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Contract view: cuts of every document and digests of its output and of the text rebuilt from that."""
    made = transformed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def oracle() -> str:
    return r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents),
g AS (SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p, array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m, array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s,
CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM g)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM c"""
