"""Host genes that share both ends, on either strand."""

from strandloom.operators.flank_families import transcription_block


def test_equal_genes_give_the_lesser_strand(spark):
    rows = spark.createDataFrame([(i, 15, "+", 0) for i in range(8)] + [(8, None, "+", 0)], "key long, place long, strand string, gene int")
    starts = spark.createDataFrame([(3, "+"), (90, "-")], "tss long, strand string")
    genes = spark.createDataFrame([(12, 20, "-")] * 4 + [(12, 20, "+")] + [(12, 30, "-"), (2, 40, "-")], "left long, right long, strand string").coalesce(1)
    expression = spark.createDataFrame([(0, 1.0)], "gene int, level double")
    for order in ("strand", "left"):
        out = transcription_block(rows, starts, genes.sort(order, ascending=False), expression, 100, 4, 54)
        found = {tuple(r)[1:] for r in out.where("key < 8").select("key", "`eng.tx.gene.template_strand`", "`eng.tx.gene.length`").collect()}
        assert found == {(0.0, 9)}
        assert out.count() == 9
        assert out.where("key = 8").first()["eng.tx.gene.length"] is None
