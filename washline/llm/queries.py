"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from washline.llm import (decontaminate, langid, linededup, mixing, neardup, periodic, quality, rules, simplex,
                          substrings, toxicity, urlfilter, warc)



def pipeline(spark, sf_dir: str):
    """The pipeline's module lies beside the package, so it is looked for when it runs."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_toxicity": toxicity.op1_query,
    "op2_mixing": mixing.op2_query,
    "op3_urlfilter": urlfilter.op3_query,
    "op4_substrings": substrings.op4_query,
    "op5_warc": warc.op5_query,
    "op6_neardup": neardup.op6_query,
    "op7_decontaminate": decontaminate.op7_query,
    "op8_rules": rules.op8_query,
    "op9_langid": langid.op9_query,
    "op10_quality": quality.op10_query,
    "op11_linededup": linededup.op11_query,
    "op12_periodic": periodic.op12_query,
    "op13_simplex": simplex.op13_query,
}

ORACLE_SQL = {
    "op2_mixing": mixing.ORACLE_SQL,
    "op5_warc": warc.ORACLE_SQL,
    "op11_linededup": linededup.ORACLE_SQL,
}
