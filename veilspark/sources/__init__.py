"""Files in and out: text, workbooks, word-processor documents, mappings."""
