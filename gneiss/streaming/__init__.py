"""gneiss.streaming"""
