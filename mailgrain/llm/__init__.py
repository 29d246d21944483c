"""Operators for preparing training text. Nothing else in the library imports this package."""

from pyspark import cloudpickle

from mailgrain.llm import arrays, crf, minhash, packed, pieces, pii_rules, prefix_crc, quality_net, warc_bytes, word_runs

# Executors get the array helpers with the task, so the package need not be installed there.
for _module in (arrays, crf, minhash, packed, pieces, pii_rules, prefix_crc, quality_net, warc_bytes, word_runs):
    cloudpickle.register_pickle_by_value(_module)
