"""Queries of the corpus operators and the SQL of those that SQL can express."""

from tessella.llm import chat, decontaminate, html, lines, mixing, neighbours, ngram, quality, repair, secrets, simhash, toxicity

QUERIES = {
    "op1_mix_sources": mixing.query,
    "op2_line_dedup": lines.query,
    "op3_ngram_scores": ngram.query,
    "op4_simhash_near_dups": simhash.query,
    "op5_html_extract": html.query,
    "op6_toxicity": toxicity.query,
    "op7_quality_rules": quality.query,
    "op8_chat_format": chat.query,
    "op9_secret_scan": secrets.query,
    "op10_decontaminate": decontaminate.query,
    "op11_repair_conversations": repair.query,
    "op12_learned_neighbours": neighbours.query,
}
ORACLES = {"op1_mix_sources": mixing.ORACLE, "op2_line_dedup": lines.ORACLE, "op8_chat_format": chat.ORACLE, "op11_repair_conversations": repair.ORACLE}
