"""Analytics for long multichannel recordings and for text corpora, on Spark DataFrames."""
