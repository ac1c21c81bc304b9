"""gneiss.sources"""
