"""Training-data operators: near and exact deduplication, language modelling,
tokenising, sharding, quality rules, language identification, chat formatting
and source mixing.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its queries
only where it can be imported.
"""
