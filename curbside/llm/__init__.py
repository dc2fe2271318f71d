"""Training-data operators: deduplication, classification, extraction and tokenisation of text corpora.

Nothing outside this subpackage imports it. Each module holds one operator as a function from
DataFrame to DataFrame; ``queries`` binds them to the tables of a data folder.
"""
