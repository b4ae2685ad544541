"""Input readers, the invoice-line view over the test tables, and file sinks."""
