"""DataFrame operators over spans, sentences, candidates and reports."""
