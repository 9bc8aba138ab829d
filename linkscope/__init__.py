"""Link graphs and the documents behind them, measured with Spark."""
