"""Keyword-watchlist analytics over articles, print pages, transcripts and tickers, as Spark DataFrame operators."""
