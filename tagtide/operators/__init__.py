"""DataFrame -> DataFrame operators over sentences, tokens and spans."""
