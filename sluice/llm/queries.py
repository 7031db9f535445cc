"""The queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from . import ann, bpe, chat, exact_dedup, html_text, pack, pipeline, shard, simhash, toxicity, warc


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_shard": shard.op2_shard,
        "op3_pack": pack.op3_pack,
        "op4_ann": ann.op4_ann,
        "op5_exact_dedup": exact_dedup.op5_exact_dedup,
        "op6_bpe": bpe.op6_bpe,
        "op7_chat": chat.op7_chat,
        "op8_warc": warc.op8_warc,
        "op9_html": html_text.op9_html,
        "op10_simhash": simhash.op10_simhash,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": exact_dedup.OP5_SQL, "op7_chat": chat.OP7_SQL, "op8_warc": warc.OP8_SQL}
