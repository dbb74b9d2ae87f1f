"""The corpus operators' queries, by name, and SQL for those that SQL can express."""

from . import brown_lm, decontamination, exact_topk, fill_middle, language_id, license_scan, mixing, mpeg_audio, prefix_trie, simhash, token_store, toxicity, wrapper


def queries() -> dict:
    return {
        "op1_language_id": language_id.query,
        "op2_decontamination": decontamination.query,
        "op3_token_output": token_store.query,
        "op4_mpeg_audio": mpeg_audio.query,
        "op5_brown_lm": brown_lm.query,
        "op6_wrapper_text": wrapper.query,
        "op7_toxicity": toxicity.query,
        "op8_license_scan": license_scan.query,
        "op9_simhash_groups": simhash.query,
        "op10_source_mixing": mixing.query,
        "op11_exact_topk": exact_topk.query,
        "op12_prefix_trie": prefix_trie.query,
        "op13_fill_in_middle": fill_middle.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": decontamination.SQL, "op11_exact_topk": exact_topk.SQL, "op12_prefix_trie": prefix_trie.SQL, "op13_fill_in_middle": fill_middle.SQL}
