"""Planning of size-bounded parts."""
