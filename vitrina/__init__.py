"""Store-catalog snapshot analytics on Spark.

Three steps, each a set of DataFrame jobs: normalise captured pages and feeds
into one product table, keep every capture as a dated snapshot, and compare
the snapshots of many stores at once to estimate what they sold.
"""
