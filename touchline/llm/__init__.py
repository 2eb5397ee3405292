"""Training-data operators over the free text of match records; nothing else in the library imports this subpackage."""
