"""The lazy frame and its row-order bookkeeping."""
