"""op4 reads what it returns from expanded prefixes and targets."""

import duckdb
from pyspark.sql import functions as F
from tessera.llm.chat import examples, expanded, formatted
from tessera.llm.queries import OP4_SQL, op4_chat_prefix_targets


def test_op4_expands_prefixes_and_matches_its_sql(spark, sf):
    out = op4_chat_prefix_targets(spark, sf)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    assert sorted(tuple(r) for r in out.collect()) == sorted(con.sql(OP4_SQL).fetchall())


def test_expanded_holds_the_prompts_of_examples(spark):
    rows = [(1, 0, "user", "hi <s>"), (1, 1, "assistant", "yo"), (1, 2, "user", None), (1, 3, "assistant", "[INST] b"), (2, 0, "user", "x")]
    chats = formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = chats.select("conv_id", F.inline(expanded("formatted", "spans", lambda p, c: F.struct(p.alias("p"), c.alias("c")))))
    assert sorted(map(tuple, got.collect())) == sorted((r.conv_id, r.prompt, r.completion) for r in examples(chats).collect())
    assert got.count() == 2
