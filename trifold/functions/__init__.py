"""Column functions and the text kernels behind them."""
