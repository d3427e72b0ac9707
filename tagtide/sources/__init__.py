"""Sources and sinks: IOB2 text files, the tagged corpus, file manifests."""
