"""Training-data operators: joins on word shingles, scoring, mixing, scanning and placement.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
