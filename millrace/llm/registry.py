"""The queries of this subpackage and their SQL."""

from . import ann, bpe, chat, langid, lines, merkle, neardup_vectors, packing, secrets, simhash, substrings, trie, warc

QUERIES = {
    "op1_nn_descent": ann.op1_nn_descent,
    "op2_packing": packing.op2_packing,
    "op3_secrets": secrets.op3_secrets,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_language_id": langid.op5_language_id,
    "op6_line_dedup": lines.op6_line_dedup,
    "op7_suffix_array_dedup": substrings.op7_suffix_array_dedup,
    "op8_simhash": simhash.op8_simhash,
    "op9_chat": chat.op9_chat,
    "op10_embedding_near_dedup": neardup_vectors.op10_embedding_near_dedup,
    "op11_warc": warc.op11_warc,
    "op12_merkle": merkle.op12_merkle,
    "op13_prefix_trie": trie.op13_prefix_trie,
}
ORACLES = {
    "op6_line_dedup": lines.OP6_SQL,
    "op9_chat": chat.OP9_SQL,
    "op10_embedding_near_dedup": neardup_vectors.OP10_SQL,
    "op11_warc": warc.OP11_SQL,
    "op12_merkle": merkle.OP12_SQL,
    "op13_prefix_trie": trie.OP13_SQL,
}
