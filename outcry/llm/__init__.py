"""Training-data operators (toxicity, token counts, decontamination, byte-level
BPE, exact top-k, token files, WARC bundles, near-duplicates, surrogates, chat
formatting, packing, conversation repair, Merkle manifests).  Nothing outside this subpackage imports it."""
