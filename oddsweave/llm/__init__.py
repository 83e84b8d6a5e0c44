"""Training-data operators: scoring, rules, shuffles, dedup, packing, decontamination.

Nothing outside this folder (and ``corpus_pipeline.py``) imports from here.
"""
