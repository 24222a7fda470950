"""No operator here: captures are analysed in whole runs, and there is no streaming operator to match."""
