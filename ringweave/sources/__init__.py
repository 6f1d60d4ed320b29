"""Reading patterns, circuits and tables; writing witnesses."""
