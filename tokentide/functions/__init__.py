"""Column builders. Everything here is a native expression but for the Jaro-Winkler UDF and the decoders."""
