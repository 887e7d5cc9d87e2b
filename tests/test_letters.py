"""Words with a repeated stretch, where matching blocks find fewer letters than the words have in common."""

from parlance.operators import spelling as S
from parlance.plans import registry
from parlance.session import new_path
from tests.compare import rows_of, rows_of_sql


def test_known_form_of_a_stuttered_word(spark):
    folder = new_path(spark, "stuttered")
    texts = [(i, text) for i, text in enumerate(["erbeerber lichchach", *["Erberber lichachach"] * 3])]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    columns, found = rows_of(registry.QUERIES["f21_known_form"](spark, folder))
    sql = registry.ORACLES["f21_known_form"].replace("FROM documents", f"FROM '{folder.removeprefix('file:')}/documents.parquet/*.parquet'")
    assert (columns, found) == rows_of_sql(sql)
    assert len(found) == 2


def test_common_letters():
    assert [S.common_letters(a, b) for a, b in (("erbeerber", "erberber"), ("abc", ""), ("abcd", "acbd"), ("xy", "ab"))] == [8, 0, 3, 0]
